"""Scalar column functions (F*, P*): all built-in Spark expressions, so they
stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespace names and their aspect codes.
NAMESPACE_CODES = {
    "biological_process": "BPO",
    "molecular_function": "MFO",
    "cellular_component": "CCO",
}
# One-letter aspect codes of annotation files.
LETTER_CODES = {"P": "BPO", "F": "MFO", "C": "CCO"}
# Default qualifier per one-letter aspect when the qualifier is blank.
DEFAULT_QUALIFIER = {"F": "enables", "P": "involved_in", "C": "located_in"}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def clean_id(c) -> Column:
    """strip a ``b'..'`` bytes repr; ``sp|ID|NAME`` -> ``ID``; else the text before the first space."""
    s = F.regexp_replace(_c(c), r"^b'(.*)'$", "$1")
    s = F.trim(s)
    return F.when(s.contains("|"), F.split(s, r"\|").getItem(1)).otherwise(F.split(s, " ").getItem(0))


def header_field(header, key: str) -> Column:
    """value of ``KEY=value`` in a sequence header (up to the next `` XX=``)."""
    return F.nullif(F.regexp_extract(_c(header), rf"(?:^|\s){key}=(.*?)(?=\s[A-Z]{{2}}=|$)", 1), F.lit(""))


def mask_rare_residues(seq) -> Column:
    """U, Z, O, B -> X, then the letters space separated."""
    s = F.regexp_replace(_c(seq), "[UZOB]", "X")
    return F.trim(F.regexp_replace(s, "(.)", "$1 "))


def truncate_seq(seq, n: int = 1024) -> Column:
    """F4."""
    return F.substring(_c(seq), 1, n)


def aspect_code(c, unknown: str | None = None) -> Column:
    """Namespace name or one-letter code -> BPO/MFO/CCO; others unchanged, or ``unknown``."""
    m = _map({**NAMESPACE_CODES, **LETTER_CODES})
    return F.coalesce(F.element_at(m, _c(c)), _c(c) if unknown is None else F.lit(unknown))


def log10_floor(e, floor: float = -300.0) -> Column:
    """log10(e), ``floor`` when e <= 0."""
    return F.when(_c(e) > 0, F.log10(_c(e))).otherwise(F.lit(floor))


def score_bin(p, bins: int = 1000) -> Column:
    """floor(p * bins) as int."""
    return F.floor(_c(p) * bins).cast("int")


def sigmoid(x, temperature: float = 1.0) -> Column:
    """F8."""
    return 1 / (1 + F.exp(-_c(x) / temperature))


def logit(p, eps: float = 1e-6) -> Column:
    """ln(p / (1 - p)) with p clamped to [eps, 1 - eps]."""
    q = F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def safe_f(p, r) -> Column:
    """2pr / (p + r), 0 when undefined."""
    return F.when((_c(p) + _c(r)) > 0, 2 * _c(p) * _c(r) / (_c(p) + _c(r))).otherwise(F.lit(0.0))


def s_distance(ru, mi) -> Column:
    """semantic distance sqrt(ru^2 + mi^2)."""
    return F.hypot(_c(ru), _c(mi))


def smooth_label(y, eps: float, k: int) -> Column:
    """y (1 - eps) + eps / K."""
    return _c(y) * (1 - eps) + eps / k


def one_hot(idx, size: int) -> Column:
    """dense one-hot array; index -1 (or out of range) gives all zeros."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == _c(idx), 1.0).otherwise(0.0))


def masked_mean_pool(tokens, mask) -> Column:
    """mean of the token vectors (ARRAY<ARRAY<FLOAT>>) whose mask is 1."""
    kept = F.filter(F.arrays_zip(_c(tokens).alias("t"), _c(mask).alias("m")), lambda z: z["m"] == 1)
    n = F.size(kept)
    dim = F.size(_c(tokens).getItem(0))
    return F.transform(F.sequence(F.lit(0), dim - 1),
                       lambda j: F.aggregate(kept, F.lit(0.0), lambda acc, z: acc + z["t"].getItem(j)) / n)


def l2_norm(vec) -> Column:
    """F14."""
    return F.sqrt(F.aggregate(_c(vec), F.lit(0.0), lambda a, x: a + x * x))


PRIME = 2147483647  # 2^31 - 1


def key_hash(*keys, seed: int = 42) -> Column:
    """Repeatable hash of integer keys in [0, 2^31 - 1): multiply-add and a squaring
    per key modulo a prime, exact in 64 bits, so any SQL engine can repeat it."""
    x = F.lit(seed).cast("long")
    for k in keys:
        c = F.pmod(_c(k).cast("long"), F.lit(PRIME))
        x = F.pmod(x * 48271 + c, F.lit(PRIME))
        x = F.pmod(x * x + c, F.lit(PRIME))
    return x


def vector_key(vec) -> Column:
    """hash key of a whole vector (exact duplicates share it), from its
    components in millionths."""
    return F.aggregate(_c(vec), F.lit(1).cast("long"), lambda a, x: F.pmod(
        a * 48271 + F.pmod(F.floor(x.cast("double") * 1000000).cast("long"), F.lit(PRIME)), F.lit(PRIME)))


def parse_int_list(s, default: list[int]) -> Column:
    """F16: "1,3,5,10" -> sorted distinct positive ints; default when empty."""
    parts = F.transform(F.split(F.coalesce(_c(s), F.lit("")), ","), lambda x: F.trim(x).try_cast("int"))
    vals = F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & (x > 0))))
    return F.when(F.size(vals) > 0, vals).otherwise(F.array(*[F.lit(int(v)) for v in default]))


def is_number(c) -> Column:
    """The string parses as a double."""
    return _c(c).try_cast("double").isNotNull()


def weight_or_zero(w) -> Column:
    """null, NaN or infinite weight -> 0."""
    x = F.nanvl(_c(w), F.lit(None).cast("double"))
    return F.when(F.abs(x) == float("inf"), F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0.0)))


def timestamped_name(prefix: str) -> Column:
    """``prefix_yyyyMMdd_HHmmss``."""
    return F.concat(F.lit(prefix + "_"), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"))


def default_qualifier(qualifier, aspect) -> Column:
    """Keep a non-blank qualifier, else the aspect's default, else ``other``."""
    q = F.trim(_c(qualifier))
    return F.when(q.isNotNull() & (q != ""), _c(qualifier)).otherwise(
        F.coalesce(F.element_at(_map(DEFAULT_QUALIFIER), _c(aspect)), F.lit("other")))


def contains_or_false(c, needle: str) -> Column:
    """Substring test with null -> false."""
    return F.coalesce(_c(c).contains(needle), F.lit(False))


def clip01(c) -> Column:
    """P11."""
    return F.least(F.greatest(_c(c), F.lit(0.0)), F.lit(1.0))


def lookup(keys: dict, c, default=None) -> Column:
    """Literal map lookup with a default."""
    v = F.element_at(_map(keys), _c(c))
    return v if default is None else F.coalesce(v, F.lit(default))
