"""Readers for the annotation world's text formats (S*), all as Spark scans
with explicit schemas (no inference), plus the sinks (K*).

Multi-line records (FASTA entries, OBO stanzas) are read with a multi-character
``lineSep`` so one text row is one record and files split across tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import header_field

# The 17 columns of an annotation snapshot (GAF 2.x) file.
GAF_COLUMNS = ["db", "entry", "symbol", "qualifier", "term", "reference", "evidence", "with_from", "aspect",
               "name", "synonym", "type", "taxon", "date", "assigned_by", "extension", "gene_product_form"]

# The 12 columns of a tabular alignment hit file (.m8).
M8_COLUMNS = ["query", "target", "fident", "alnlen", "mismatch", "gapopen", "qstart", "qend", "tstart",
              "tend", "evalue", "bits"]

# The lineage columns (taxon id + 7 ranks).
LINEAGE_COLUMNS = ["taxon", "superkingdom", "phylum", "class", "order", "family", "genus", "species"]


def _strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "\t",
                   header: bool = False, comment: str | None = None) -> DataFrame:
    """Delimited scan with a given schema; globs and .gz work natively."""
    r = spark.read.schema(schema).option("sep", sep).option("header", header)
    if comment:
        r = r.option("comment", comment)
    return r.csv(path)


def file_dialects(lines: DataFrame) -> DataFrame:
    """(file, sep, header) from the first line of every file of ``lines`` (file, start, row, value).

    Places of lines are aggregated, then the lines at them are looked up: an aggregate over the lines themselves would sort them all."""
    at = lines.where("start = 0").groupBy("file").agg(F.min("row").alias("row"))
    first = lines.where("start = 0").join(F.broadcast(at), ["file", "row"]).select("file", F.col("value").alias("_line"))
    sep = F.when(F.col("_line").contains("\t"), "\t").when(F.col("_line").contains(","), ",").otherwise(" ")
    return first.withColumn("sep", sep).select("file", "sep", F.transform(_cells("_line"), lambda c: F.lower(F.trim(c))).alias("header"))


def _cells(line: str):
    """The cells of a line by its file's separator; blanks in a row are one separator."""
    return F.when(F.col("sep") == " ", F.split(F.trim(line), " +")).when(F.col("sep") == ",", F.split(line, ",")).otherwise(F.split(line, "\t"))


def read_links(spark: SparkSession, path, min_score: float | None = None, file_col: str | None = None) -> DataFrame:
    """S2/S3 + N1 input: ``protein1 protein2 .. combined_score`` files of any separators together (a folder, a glob, a
    list; .gz too): (protein1, protein2, score[, file_col]).

    Each file's first line gives its own separator (tab, else comma, else blanks) and its own order of columns; a file without one
    of the three columns raises.  A score that is no number is null."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                       F.monotonically_increasing_id().alias("row"), "value")
    dialects = file_dialects(raw)
    # a row a file: an exchange would bring all lines of a file to one task
    lines = raw.where(F.trim("value") != "").join(F.broadcast(dialects), "file").withColumn("_c", _cells("value"))

    def cell(name):
        place = F.array_position("header", name)
        return F.when(place > 0, F.trim(F.get(F.col("_c"), (place - 1).cast("int")))).otherwise(
            F.raise_error(F.concat(F.lit(f"no column {name} in "), F.col("file"))).cast("string"))

    names = ("protein1", "protein2", "combined_score")
    got = lines.select(*[cell(n).alias(n) for n in names], "file", (F.transform("_c", lambda c: F.lower(F.trim(c))) == F.col("header")).alias("_head")).where("not _head")
    out = got.select("protein1", "protein2", F.col("combined_score").try_cast("double").alias("score"), *([F.col("file").alias(file_col)] if file_col else []))
    return out if min_score is None else out.where(F.col("score") >= min_score)


def require_columns(df: DataFrame, cols) -> None:
    """Fail early when required columns are missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def read_gaf(spark: SparkSession, path: str, columns=("entry", "term", "evidence", "aspect", "qualifier")) -> DataFrame:
    """Annotation snapshot; ``!`` lines are comments; the column subset is
    pruned right after the scan."""
    return read_delimited(spark, path, _strings(GAF_COLUMNS), comment="!").select(*columns)


def file_order():
    """A sortable place of a scanned row: file name, start of its split, and its number in the task."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                    F.monotonically_increasing_id().alias("row"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA records -> (header, id, seq, ord).

    ``id`` is the accession: the middle field of ``db|ID|NAME`` headers, else
    the first word.  Sequence lines are concatenated.  ``ord`` keeps file
    order over all files: (file name, place of the split in it, place in the split)."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    rec = raw.select(F.regexp_replace("value", r"^>", "").alias("value")).where(F.length(F.trim("value")) > 0)
    header = F.split("value", "\n").getItem(0)
    seq = F.regexp_replace(F.regexp_extract("value", r"^[^\n]*\n([\s\S]*)$", 1), r"\s", "")
    first = F.split(header, " ").getItem(0)
    acc = F.when(first.contains("|"), F.split(first, r"\|").getItem(1)).otherwise(first)
    return rec.select(F.trim(header).alias("header"), acc.alias("id"),
                      seq.alias("seq"),
                      file_order().alias("ord"))


def parse_annotated_headers(fasta: DataFrame, taxon_names: DataFrame | None = None) -> DataFrame:
    """``>src|id|gene desc OS=.. OX=.. GN=.. PE=.. SV=..`` -> source, entry,
    gene name, description, OS, OX, GN, PE, SV (numeric fields as double), the
    sequence, and the taxon looked up by OS name when a table is given."""
    h = F.col("header")
    first = F.split(h, " ").getItem(0)
    rest = F.regexp_replace(h, r"^\S+\s*", "")
    descr = F.trim(F.regexp_replace(rest, r"\s[A-Z]{2}=.*$", ""))
    out = fasta.select(
        F.split(first, r"\|").getItem(0).alias("source"), F.col("id").alias("entry"),
        F.split(first, r"\|").getItem(2).alias("gene_name"), descr.alias("descr"),
        header_field(h, "OS").alias("OS"), header_field(h, "OX").try_cast("double").alias("OX"),
        header_field(h, "GN").alias("GN"), header_field(h, "PE").try_cast("double").alias("PE"),
        header_field(h, "SV").try_cast("double").alias("SV"), "seq")
    if taxon_names is not None:
        out = out.join(taxon_names.select(F.col("name").alias("OS"), F.col("taxon").alias("taxonomyID")), "OS", "left")
    return out


def parse_simple_headers(fasta: DataFrame) -> DataFrame:
    """``>ID TAXON``; a header with fewer than two parts is an error."""
    parts = F.split(F.col("header"), r"\s+")
    return fasta.select(F.col("id").alias("entry"),
                        F.when(F.size(parts) >= 2, parts.getItem(1).try_cast("int"))
                        .otherwise(F.raise_error(F.concat(F.lit("bad header: "), F.col("header")))).alias("taxon"),
                        "seq", "ord")


def read_obo(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Ontology stanzas -> (terms, edges).

    terms: (term, name, namespace, def, alt_ids ARRAY, is_obsolete)
    edges: (child, parent, rel) from ``is_a`` and ``relationship: part_of``.
    ``strict``: obsolete terms dropped, a parent that is an alternative id stands
    for its term, edges kept only between terms of the same namespace.
    """
    st = spark.read.option("lineSep", "\n\n").text(path)
    st = st.where(F.trim("value").startswith("[Term]"))

    def one(tag):
        return F.nullif(F.regexp_extract("value", rf"(?m)^{tag}:\s*(.*?)\s*$", 1), F.lit(""))

    terms = st.select(
        one("id").alias("term"), one("name").alias("name"), one("namespace").alias("namespace"),
        one("def").alias("def"),
        F.regexp_extract_all("value", F.lit(r"(?m)^alt_id:\s*(\S+)"), 1).alias("alt_ids"),
        (one("is_obsolete") == "true").alias("is_obsolete"),
        F.regexp_extract_all("value", F.lit(r"(?m)^is_a:\s*(\S+)"), 1).alias("_isa"),
        F.regexp_extract_all("value", F.lit(r"(?m)^relationship:\s*part_of\s+(\S+)"), 1).alias("_partof"))
    terms = terms.withColumn("is_obsolete", F.coalesce("is_obsolete", F.lit(False)))
    if strict:
        terms = terms.where(~F.col("is_obsolete"))
    edges = (terms.select(F.col("term").alias("child"), F.explode("_isa").alias("parent"), F.lit("is_a").alias("rel"))
             .unionByName(terms.select(F.col("term").alias("child"), F.explode("_partof").alias("parent"),
                                       F.lit("part_of").alias("rel"))))
    terms = terms.drop("_isa", "_partof")
    if strict:
        ids = terms.select(F.col("term").alias("_id"), F.col("term").alias("_to")).unionByName(
            terms.select(F.explode("alt_ids").alias("_id"), F.col("term").alias("_to"))).dropDuplicates(["_id"])
        edges = edges.join(ids, F.col("parent") == F.col("_id")).select("child", F.col("_to").alias("parent"), "rel").distinct()
        ns = terms.select(F.col("term").alias("_t"), F.col("namespace").alias("_ns"))
        edges = (edges.join(ns.withColumnRenamed("_t", "child").withColumnRenamed("_ns", "_cns"), "child")
                 .join(ns.withColumnRenamed("_t", "parent").withColumnRenamed("_ns", "_pns"), "parent")
                 .where(F.col("_cns") == F.col("_pns")).select("child", "parent", "rel"))
    return terms, edges


def valid_term_ids(terms: DataFrame) -> DataFrame:
    """S9d: ids and alternative ids."""
    return (terms.select(F.col("term").alias("id"))
            .unionByName(terms.select(F.explode("alt_ids").alias("id"))).distinct())


def read_m8(spark: SparkSession, path: str, max_hits_per_query: int = 0) -> DataFrame:
    """Hit file; blank, ``#`` and short/non-numeric rows are skipped;
    optionally the best ``max_hits_per_query`` hits by bit score per query."""
    raw = read_delimited(spark, path, _strings(M8_COLUMNS), comment="#")
    num = {c: raw[c].try_cast("double") for c in M8_COLUMNS[2:]}
    df = raw.select("query", "target", *[num[c].alias(c) for c in M8_COLUMNS[2:]])
    df = df.where(F.col("query").isNotNull() & F.col("target").isNotNull()
                  & F.col("bits").isNotNull() & F.col("evalue").isNotNull() & F.col("fident").isNotNull())
    if max_hits_per_query > 0:
        from ..operators.ranking import top_k
        df = top_k(df, "query", "bits", max_hits_per_query, tie="target").drop("rank")
    return df


def read_ia(spark: SparkSession, path: str) -> DataFrame:
    """Two whitespace-separated columns (term, ia)."""
    t = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 2)
    return t.select(F.col("p").getItem(0).alias("term"), F.col("p").getItem(1).try_cast("double").alias("ia"))


def read_lineage(spark: SparkSession, path: str) -> DataFrame:
    """Headerless lineage rows with at least 8 tab-separated fields; the
    first 8 are kept, the taxon cast to int, blanks become null."""
    t = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    # the check stands inside the column that all others read, so it is never pruned away
    t = t.select(F.when(F.size("p") >= 8, F.col("p")).otherwise(
        F.raise_error(F.lit("lineage row with fewer than 8 columns")).cast("array<string>")).alias("p"))
    cols = [F.col("p").getItem(0).try_cast("int").alias("taxon")] + [
        F.nullif(F.trim(F.col("p").getItem(i)), F.lit("")).alias(n) for i, n in enumerate(LINEAGE_COLUMNS[1:], 1)]
    return t.select(*cols)


def read_truth(spark: SparkSession, path: str, ontologies: DataFrame) -> DataFrame:
    """Ground-truth lines ``entry term ..`` (any white space): (entry, namespace, term), distinct.  A term, or the term that an
    alternative id stands for, belongs to the first ontology that holds it; lines of unknown terms go.
    ``ontologies``: (place, namespace, term_id, term), ids and alternative ids of all ontologies in their order."""
    words = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w")).where(F.size("w") >= 2)
    own = ontologies.groupBy("term_id").agg(F.min_by(F.struct("namespace", "term"), "place").alias("_o"))
    return (words.select(F.get("w", F.lit(0)).alias("entry"), F.get("w", F.lit(1)).alias("term_id")).join(own, "term_id")
            .select("entry", F.col("_o.namespace").alias("namespace"), F.col("_o.term").alias("term")).distinct())


def read_alias_lines(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """The first two tab-separated fields (id, alias) of the lines that hold ``tag``; .gz works natively."""
    lines = spark.read.text(path).where(F.col("value").contains(tag) & ~F.col("value").startswith("#"))
    parts = F.split("value", "\t")
    return lines.select(F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("alias"))


def positional_names(df: DataFrame, names) -> DataFrame:
    """Columns renamed by place: the first to ``names``, the others to col_2, col_3 .."""
    return df.toDF(*[names[i] if i < len(names) else f"col_{i}" for i in range(len(df.columns))])


def read_json_vocab(spark: SparkSession, path: str, top_k: int | None = None) -> DataFrame:
    """``{"taxon2idx": {..}}`` or ``{"root": {"taxon2idx": {..}}}`` or a flat
    map -> sorted int keys (optionally the first K)."""
    txt = spark.read.option("wholetext", True).text(path)
    m = F.coalesce(
        F.from_json(F.get_json_object("value", "$.root.taxon2idx"), "map<string,int>"),
        F.from_json(F.get_json_object("value", "$.taxon2idx"), "map<string,int>"),
        F.from_json("value", "map<string,int>"))
    keys = txt.select(F.explode(F.map_keys(m)).alias("k")).select(F.col("k").try_cast("int").alias("taxon"))
    keys = keys.where(F.col("taxon").isNotNull()).orderBy("taxon")
    return keys.limit(top_k) if top_k else keys


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id per line, trimmed, blanks removed."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where(F.col("id") != "")


def read_predictions(spark: SparkSession, path: str, truth: DataFrame | None = None,
                     max_terms: int | None = None) -> DataFrame:
    """Headerless (entry, term, prob) text; a header row (non-numeric
    score) is dropped; repeated pairs keep the max; only entries of ``truth``;
    optionally the first ``max_terms`` rows per entry in file order."""
    raw = read_delimited(spark, path, "entry string, term string, prob string")
    df = (raw.withColumn("prob", F.col("prob").try_cast("double")).where(F.col("prob").isNotNull())
          .withColumn("ord", file_order()))
    if truth is not None:
        df = df.join(truth.select("entry").distinct(), "entry", "left_semi")
    if max_terms:
        from pyspark.sql import Window
        w = Window.partitionBy("entry").orderBy("ord")
        df = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_terms).drop("_rn")
    return df.groupBy("entry", "term").agg(F.max("prob").alias("prob"))


# ------------------------------------------------------------------------ sinks

def write_submission(df: DataFrame, path: str, decimals: int = 3, mode: str = "overwrite") -> None:
    """K1/K3: one headerless TSV dataset of (entry, term, score) with the score
    formatted to ``decimals`` places (one write, no append loop)."""
    out = df.select(F.col("entry").cast("string"), F.col("term").cast("string"),
                    F.format_string(f"%.{decimals}f", F.col("prob")).alias("prob"))
    out.write.mode(mode).option("sep", "\t").option("header", False).csv(path)


def truncate_score(c, decimals: int = 3):
    """K2 (re-aimed): truncation to ``decimals`` places, numerically (the string
    slicing of the reference breaks on exponent notation)."""
    f = 10 ** decimals
    return F.floor(F.col(c) * f) / f


def write_partitioned(df: DataFrame, path: str, by: str = "namespace", mode: str = "overwrite") -> None:
    """K4/K5/K8: parquet, one folder per ``by`` value."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def dense_to_long(df: DataFrame, labels: DataFrame, vec: str = "scores", min_score: float = 0.001,
                  decimals: int = 3) -> DataFrame:
    """Dense score vectors (entry, scores ARRAY) -> long (entry, term, prob)
    with prob >= min_score, rounded; ``labels`` maps position -> term."""
    long = df.select("entry", F.posexplode(vec).alias("pos", "prob")).where(F.col("prob") >= min_score)
    lab = labels.select(F.col("idx").alias("pos"), "term")
    return long.join(F.broadcast(lab) if labels.count() < 1_000_000 else lab, "pos").select(
        "entry", "term", F.round("prob", decimals).alias("prob"))


def write_json_vocab(values: DataFrame, path: str, col: str = "taxon", name: str = "taxon2idx") -> None:
    """K7: the distinct values of ``col``, numbered in order, as one JSON object ``{"taxon2idx": {value: index}}``.
    A vocabulary is one object by its format, so it passes through one task."""
    from ..operators.features import dense_ids
    idx = dense_ids(values, col, "idx")
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(col).cast("string").alias("key"), F.col("idx").alias("value")))))
    idx.agg(F.to_json(F.struct(entries.alias(name))).alias("value")).write.text(path)
