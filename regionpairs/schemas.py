"""Schemas of the tables and files that the toolkit reads."""

SEQUENCE = "cohort string, set_id string, gene string, grp string, kind string, chrom string, start bigint, stop bigint, side string, pair_label string, seq string, src_path string"
HIT = "qseqid string, sseqid string, pident double, length int, qstart bigint, qend bigint, sstart bigint, send bigint, evalue double, sseq string"
BED = "chrom string, start bigint, stop bigint, name string, score double, strand string"
#: Header of the collated file (fixed values).
COLLATED = ["Gene Name", "Comparisons", "qseqid", "sseqid", "pident", "length", "qstart", "qend", "sstart", "send", "evalue", "sseq"]
#: Substitution scores of the alignment reports (fixed values, symmetric) and their affine gap costs.
MATRIX = [("A", "A", 91), ("C", "C", 100), ("G", "G", 100), ("T", "T", 91), ("A", "C", -114), ("A", "G", -31), ("A", "T", -123), ("C", "G", -125), ("C", "T", -31), ("G", "T", -114)]
GAP_OPEN, GAP_EXTEND = 400, 30
