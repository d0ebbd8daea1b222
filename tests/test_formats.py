"""Format readers round-trip driver-derived data written as text files."""

import os
import tempfile

from pyspark.sql import functions as F

from termflow.sources import fixtures as fx
from termflow.sources import formats as fm

SF = "/root/testdata/sf0.001"


def _tmp():
    return tempfile.mkdtemp(prefix="termflow-test-", dir="/tmp")


def test_gaf_roundtrip(spark):
    ev = fx.evidence(spark, SF).limit(300).collect()
    d = _tmp()
    with open(os.path.join(d, "a.gaf"), "w") as f:
        f.write("!gaf-version: 2.2\n")
        for r in ev:
            cols = ["DB", str(r.entry), "S", "", str(r.term), "REF", r.code, "", "PFC"[r.aspect], "", "", "protein",
                    "taxon:1", "20200101", "X", "", ""]
            f.write("\t".join(cols) + "\n")
    got = fm.read_gaf(spark, d).collect()
    assert len(got) == len(ev)
    assert {(g.entry, g.term, g.evidence) for g in got} == {(str(r.entry), str(r.term), r.code) for r in ev}


def test_fasta_annotated_and_simple(spark):
    docs = fx.table(spark, SF, "documents").select("doc_id", "text").limit(20).collect()
    d = _tmp()
    with open(os.path.join(d, "a.fasta"), "w") as f:
        for r in docs:
            seq = "".join(ch for ch in r.text.upper() if ch.isalpha())[:300] or "M"
            f.write(f">sp|P{r.doc_id}|G{r.doc_id}_HUMAN Some protein OS=Homo sapiens OX=9606 GN=G{r.doc_id} PE=1 SV=2\n")
            for i in range(0, len(seq), 60):
                f.write(seq[i:i + 60] + "\n")
    fa = fm.read_fasta(spark, d)
    rows = fm.parse_annotated_headers(fa).collect()
    assert len(rows) == len(docs)
    r0 = [r for r in rows if r.entry == f"P{docs[0].doc_id}"][0]
    assert r0.OS == "Homo sapiens" and r0.OX == 9606.0 and r0.PE == 1.0 and r0.SV == 2.0
    assert r0.gene_name == f"G{docs[0].doc_id}_HUMAN" and r0.descr == "Some protein"
    exp = "".join(ch for ch in docs[0].text.upper() if ch.isalpha())[:300] or "M"
    assert r0.seq == exp
    with open(os.path.join(d, "b.fa"), "w") as f:
        f.write(">A1 9606\nMKV\nLL\n>B2 10090\nMM\n")
    simple = {r.entry: (r.taxon, r.seq) for r in fm.parse_simple_headers(fm.read_fasta(spark, os.path.join(d, "b.fa"))).collect()}
    assert simple == {"A1": (9606, "MKVLL"), "B2": (10090, "MM")}


def test_obo_matches_fixture_dag(spark):
    terms = fx.terms(spark, SF).collect()
    edges = fx.edges(spark, SF).collect()
    parents = {}
    for e in edges:
        parents.setdefault(e.child, []).append(e.parent)
    ns = ["biological_process", "molecular_function", "cellular_component"]
    d = _tmp()
    with open(os.path.join(d, "g.obo"), "w") as f:
        f.write("format-version: 1.2\n\n")
        for t in terms:
            f.write(f"[Term]\nid: T:{t.term}\nname: {t.name}\nnamespace: {ns[t.namespace]}\n")
            for p in parents.get(t.term, []):
                f.write(f"is_a: T:{p} ! parent\n")
            f.write("\n")
        f.write("[Term]\nid: T:obsolete\nname: old\nnamespace: biological_process\nis_obsolete: true\n\n")
        f.write("[Typedef]\nid: part_of\nname: part of\n")
    t, e = fm.read_obo(spark, d)
    assert t.count() == len(terms)
    got = {(r.child, r.parent) for r in e.collect()}
    assert got == {(f"T:{x.child}", f"T:{x.parent}") for x in edges}


def test_m8_and_ia(spark):
    d = _tmp()
    with open(os.path.join(d, "h.m8"), "w") as f:
        f.write("# comment\n\nq1\tt1\t0.9\t100\t1\t0\t1\t100\t1\t100\t1e-30\t200\n")
        f.write("q1\tt2\t0.5\t100\t1\t0\t1\t100\t1\t100\t1e-10\t90\nq1\tt3\tbad\nq2\tt1\t0.7\t80\t1\t0\t1\t80\t1\t80\t1e-5\t50\n")
    h = fm.read_m8(spark, d, max_hits_per_query=1).collect()
    assert {(r.query, r.target) for r in h} == {("q1", "t1"), ("q2", "t1")}
    with open(os.path.join(d, "ia.txt"), "w") as f:
        f.write("T:1 0.5\nT:2\t1.25\n")
    ia = {r.term: r.ia for r in fm.read_ia(spark, os.path.join(d, "ia.txt")).collect()}
    assert ia == {"T:1": 0.5, "T:2": 1.25}


def test_predictions_reader_and_submission_sink(spark):
    d = _tmp()
    p = os.path.join(d, "p.tsv")
    with open(p, "w") as f:
        f.write("EntryID\tterm\tprob\nA\tT1\t0.5\nA\tT1\t0.7\nB\tT2\t0.1\nC\tT3\t0.9\n")
    truth = spark.createDataFrame([("A",), ("B",)], "entry string")
    got = {(r.entry, r.term): r.prob for r in fm.read_predictions(spark, p, truth).collect()}
    assert got == {("A", "T1"): 0.7, ("B", "T2"): 0.1}
    out = os.path.join(d, "sub")
    fm.write_submission(spark.createDataFrame([("A", "T1", 0.12345)], "entry string, term string, prob double"), out)
    text = "".join(open(os.path.join(out, x)).read() for x in os.listdir(out) if x.startswith("part-"))
    assert text.strip() == "A\tT1\t0.123"


def test_lineage_rows_too_short_raise(spark, tmp_path):
    import pytest
    (tmp_path / "ok.tsv").write_text("\t".join(["9", *"abcdefg"]) + "\n")
    assert fm.read_lineage(spark, str(tmp_path / "ok.tsv")).first().taxon == 9
    (tmp_path / "bad.tsv").write_text("9\ta\n")
    with pytest.raises(Exception, match="fewer than 8"):
        fm.read_lineage(spark, str(tmp_path / "bad.tsv")).select("taxon").collect()


def test_first_rows_in_file_order_over_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.tsv").write_text("".join(f"E1\tT{k}{i}\t0.{9 - i}\n" for i in range(4)))
    got = fm.read_predictions(spark, f"{tmp_path}/p*.tsv", max_terms=6)
    assert sorted(r.term for r in got.collect()) == ["T00", "T01", "T02", "T03", "T10", "T11"]
