import csv

from regionpairs.sources import readers, sinks

HEAD = """##maf version=1
# tool v.1 a[unmask] b[unmask] --strand=both
#   A    C    G    T
#  91 -114  -31 -123
"""
BLOCK = """# identity=28/36 (77.8%)
# coverage=37/200 (18.5%)
# continuity=36/37 (97.3%)
# cigar=23m1d13m
a score=1633
s chr3R 21 37 + 200 AGGGCACGTGCTCAGCTTGACTTCTGAGATACTTCTT
s chr3R 334 36 - 374 AGGACACGCGCTCCGCTTGACCT-TGACATTGTTCCT

"""


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_sequences(spark, tmp_path):
    root = tmp_path / "tree"
    put(root / "Abd-B" / "a__b" / "x.fa", ">chr3R:10-14 label=Abd-B role=LEFT\nAC\ngt\n")
    put(root / "set_sm" / "a__b" / "f.fa", ">chr3R:4-10 side=LEFT set=set_sm pair=chr3R:10-14__chr3R:20-24\nACGTAC\n>chr3R:14-16 side=RIGHT set=set_sm pair=p\nAC\n")
    put(root / "set_sm" / "a__b" / ".hidden.fa", ">chr1:1-2\nA\n")
    put(root / "set_sm" / "empty.fa", "")
    put(root / "set_sm" / "odd.fa", ">no coordinates\nAC\n")
    put(root / "notes.txt", "x")
    got = {(r.kind, r.chrom, r.start): r for r in readers.read_sequences(spark, str(root)).collect()}
    assert len(got) == 4
    r = got["body", "chr3R", 10]
    assert (r.set_id, r.gene, r.grp, r.stop, r.side, r.seq) == ("Abd-B", "Abd-B", None, 14, "LEFT", "ACgt")
    r = got["flank", "chr3R", 4]
    assert (r.set_id, r.gene, r.grp, r.side, r.pair_label, r.seq) == ("set_sm", "set", "sm", "LEFT", "chr3R:10-14__chr3R:20-24", "ACGTAC")
    assert got["body", None, None].set_id == "set_sm"
    assert {r.set_id for r in readers.discover_sets(spark, str(root)).collect()} == {"Abd-B", "set_sm"}


def test_alignments(spark, tmp_path):
    root = tmp_path / "maf"
    put(root / "g1" / "c_1-2__c_5-9" / "alignments" / "enhancers" / "r.maf", HEAD + BLOCK + BLOCK.replace("1633", "-7"))
    put(root / "g1" / "c_1-2__c_15-19" / "alignments" / "enhancers" / "r.maf", HEAD)
    runs, blocks = readers.read_alignments(spark, str(root))
    assert {(r.set_id, r.pair_id) for r in runs.collect()} == {("g1", "c_1-2__c_5-9"), ("g1", "c_1-2__c_15-19")}
    assert len(runs.first().comments) >= 4
    params = runs.where("pair_id = 'c_1-2__c_5-9'").first().params
    assert params["identity"] == "28/36 (77.8%)" and params["cigar"] == "23m1d13m" and params["tool v.1 a[unmask] b[unmask] --strand"] == "both"
    got = blocks.orderBy("block").collect()
    assert [(b.pair_id, b.block, b.score) for b in got] == [("c_1-2__c_5-9", 0, 1633), ("c_1-2__c_5-9", 1, -7)]
    b = got[0]
    assert (b.t.start, b.t.size, b.t.strand, b.q.start, b.q.strand, b.q.total, b.cigar) == (21, 37, "+", 334, "-", 374, "23m1d13m")
    assert (b.identity.n, b.identity.d, b.coverage.d) == (28, 36, 200) and b.q.text.count("-") == 1


def test_hits_and_collated_file(spark, tmp_path):
    root = tmp_path / "hits"
    put(root / "geneA" / "Comparisons_1" / "x_y", "q1\ts1\t97.5\t40\t1\t40\t90\t51\t1e-12\tACGT\nq1\ts1\t90\t20\t3\t22\t5\t24\t0.0001\tA,\"C\n")
    put(root / "geneB" / "Comparisons_1" / "empty", "")
    hits = readers.read_hits(spark, str(root))
    rows = hits.orderBy("evalue").collect()
    assert [(r.set_id, r.comparison, r.pident, r.send, r.evalue) for r in rows] == [("geneA", "x_y", 97.5, 51, 1e-12), ("geneA", "x_y", 90.0, 24, 1e-4)]
    sinks.write_collated(hits, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("*.csv")
    lines = list(csv.reader(part.open(newline="")))
    assert lines[0][:3] == ["Gene Name", "Comparisons", "qseqid"] and len(lines) == 3 and len(lines[1]) == 12
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    raw = part.read_bytes()
    assert raw.count(b"\r\n") == raw.count(b"\n") == 3
    # one file from all parts in order: one header
    sinks.write_collated(hits.repartition(3), str(tmp_path / "one"), one_header=True)
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "one").glob("part-*")))
    assert whole.split(b"\r\n")[0] == raw.split(b"\r\n")[0] and sorted(whole.split(b"\r\n")) == sorted(raw.split(b"\r\n"))


def test_intervals_and_set_sink(spark, tmp_path):
    put(tmp_path / "t.bed", "track x\n#c\nchr1\t5\t9\tte1\t3.5\t-\nchr1\t7\t8\n\nchr2\tx\t8\n")
    got = sorted(map(tuple, readers.read_intervals(spark, str(tmp_path / "t.bed")).collect()), key=repr)
    assert got == sorted([("chr1", 5, 9, "te1", 3.5, "-"), ("chr1", 7, 8, None, None, None), ("chr2", None, 8, None, None, None)], key=repr)
    bad = readers.bad_records(readers.read_intervals(spark, str(tmp_path / "t.bed")), "chrom", ["start", "stop"])
    assert {tuple(r) for r in bad.collect()} == {("chr1", 2, 0), ("chr2", 1, 1)}
    out = str(tmp_path / "sets")
    sinks.write_by_set(spark.createDataFrame([("a", 1), ("b", 2)], "set_id string, x int"), out)
    sinks.write_by_set(spark.createDataFrame([("b", 3)], "set_id string, x int"), out)
    assert {(r.set_id, r.x) for r in spark.read.parquet(out).collect()} == {("a", 1), ("b", 3)}
    # a set that was worked on and has no rows any more
    sinks.write_by_set(spark.createDataFrame([("b", 4)], "set_id string, x int"), out, sets=spark.createDataFrame([("a",), ("b",), ("c",)], "set_id string"))
    assert {(r.set_id, r.x) for r in sinks.read_by_set(spark, out).collect()} == {("b", 4)} == {(r.set_id, r.x) for r in spark.read.parquet(out).collect()}
    # a row of nulls is a row; names of folders are escaped
    sinks.write_by_set(spark.createDataFrame([("x/y=1", None), (None, 1)], "set_id string, x int"), out)
    sinks.write_by_set(spark.createDataFrame([("b", 5)], "set_id string, x int"), out, sets=spark.createDataFrame([("x/y=1",)], "set_id string"))
    assert {(r.set_id, r.x) for r in spark.read.parquet(out).collect()} == {("b", 5), (None, 1)}


def test_genome_chunks(spark, tmp_path):
    from regionpairs.operators import flanks

    put(tmp_path / "g.fa", ">chr1 first\nACGT\nacg\n>chr2\nTTTTT\n>chr3\n")
    parts = readers.read_genome(spark, str(tmp_path / "g.fa"), size=3)
    assert sorted(tuple(r) for r in parts.collect()) == [("chr1", 0, "ACG"), ("chr1", 1, "Tac"), ("chr1", 2, "g"), ("chr2", 0, "TTT"), ("chr2", 1, "TT"), ("chr3", 0, "")]
    spans = spark.createDataFrame([(1, "chr1", 2, 7), (2, "chr2", 0, 4)], "id int, chrom string, start bigint, stop bigint")
    assert {(r.id, r.seq) for r in flanks.extract(spans, parts, ["chrom"], ["id"], size=3).collect()} == {(1, "GTacg"), (2, "TTTT")}
