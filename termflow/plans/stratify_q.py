"""Multi-label stratified folds (E14): the same rounds, unrolled in SQL."""

from __future__ import annotations

from ..operators import stratify
from ..sources import fixtures as fx
from .common import ANNOT, key_hash_sql, register, sql

TOP, FOLDS = 32, 5


def rounds_sql() -> str:
    out = [f"""f AS (SELECT term, count(*) AS n FROM annot GROUP BY term),
top AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) - 1 AS l FROM f QUALIFY row_number() OVER (ORDER BY n DESC, term) <= {TOP}),
own AS MATERIALIZED (SELECT DISTINCT a.entry, t.l FROM annot a JOIN top t ON a.term = t.term),
folds AS (SELECT unnest(generate_series(0, {FOLDS - 1})) AS fold),
s0 AS MATERIALIZED (SELECT DISTINCT entry, {key_hash_sql('entry')} AS h, CAST(NULL AS BIGINT) AS fold FROM annot)"""]
    for r in range(1, TOP + 2):  # a label a round, then those without one
        p = f"s{r - 1}"
        out.append(f"""o{r} AS MATERIALIZED (SELECT o.l, count(*) AS n FROM own o JOIN {p} s ON s.entry = o.entry WHERE s.fold IS NULL GROUP BY o.l ORDER BY n, o.l LIMIT 1),
g{r} AS MATERIALIZED (SELECT fold, (SELECT count(*) FROM {p} s WHERE s.fold = folds.fold) AS size,
  CASE WHEN (SELECT count(*) FROM o{r}) = 0 THEN (SELECT count(*) FROM {p} s WHERE s.fold = folds.fold)
       ELSE (SELECT count(*) FROM {p} s JOIN own o ON o.entry = s.entry WHERE s.fold = folds.fold AND o.l = (SELECT l FROM o{r})) END AS got FROM folds),
n{r} AS MATERIALIZED (SELECT CASE WHEN (SELECT count(*) FROM o{r}) = 0 THEN (SELECT count(*) FROM {p} WHERE fold IS NULL) ELSE (SELECT n FROM o{r}) END AS n),
l{r} AS (SELECT fold, size, greatest((SELECT n FROM n{r}) + (SELECT sum(got) FROM g{r}) - {FOLDS} * got, 0) AS lack FROM g{r}),
w{r} AS (SELECT fold, size, CASE WHEN (SELECT sum(lack) FROM l{r}) = 0 THEN 1 ELSE lack END AS w,
  CASE WHEN (SELECT sum(lack) FROM l{r}) = 0 THEN {FOLDS} ELSE (SELECT sum(lack) FROM l{r}) END AS whole FROM l{r}),
q{r} AS (SELECT fold, (SELECT n FROM n{r}) * w // whole AS base, row_number() OVER (ORDER BY (SELECT n FROM n{r}) * w % whole DESC, size, fold) AS nth FROM w{r}),
e{r} AS MATERIALIZED (SELECT fold, sum(base + CASE WHEN nth <= (SELECT n FROM n{r}) - (SELECT sum(base) FROM q{r}) THEN 1 ELSE 0 END) OVER (ORDER BY fold) AS upto FROM q{r}),
t{r} AS (SELECT entry, row_number() OVER (ORDER BY h, entry) AS rank FROM {p} WHERE fold IS NULL
  AND ((SELECT count(*) FROM o{r}) = 0 OR entry IN (SELECT entry FROM own WHERE l = (SELECT l FROM o{r})))),
s{r} AS MATERIALIZED (SELECT s.entry, s.h, coalesce(s.fold, (SELECT min(e.fold) FROM e{r} e WHERE e.upto >= t.rank)) AS fold FROM {p} s LEFT JOIN t{r} t ON t.entry = s.entry)""")
    return ",\n".join(out)


@register("e14_multilabel_folds", sql(ANNOT, rounds_sql(), body=f"SELECT entry, CAST(fold AS INTEGER) AS fold FROM s{TOP + 1}"))
def e14_multilabel_folds(s, d):
    return stratify.stratified_label_folds(fx.annotations(s, d).select("entry", "term"), FOLDS, TOP)
