import pytest

from cladespark.sources import formats, readers

SEQ = [(1, "a", "ACGTAC"), (2, "b", "AC-TAC"), (3, "c", "ACGTNN")]


def test_phylip_forms():
    assert formats.parse_phylip("3 6\na ACGTAC\nb AC-TAC\nc ACGTNN\n") == SEQ
    assert formats.parse_phylip("3 6\na ACG\nTAC\nb AC-TAC\nc ACG\nTNN\n") == SEQ
    assert formats.parse_phylip(" 3 6\na ACG\nb AC-\nc ACG\n\nTAC\nTAC\nTNN\n") == SEQ
    for bad in ("", "0 6\n", "3 6\na ACGTAC\n", "1 3\na ACGT\n", "x y\n"):
        with pytest.raises(ValueError):
            formats.parse_phylip(bad)


def test_fasta():
    assert formats.parse_fasta(">a \nACG\nTAC\n>b\nAC-TAC\n>c\nACG TNN") == SEQ
    for bad in ("", ">a\nAC\n>b\nACG\n", ">a\nA1$\n"):
        with pytest.raises(ValueError):
            formats.parse_fasta(bad)


def test_partition_text():
    specs = formats.parse_partitions("DNA, g1 = 1-300\nASC_WAGF, g2 = 301-400/3, 500\nJTTX,g3=7\n")
    assert specs[1] == {"ord": 1, "model": "WAG", "asc": True, "freq_mode": "empirical", "name": "g2", "regions": [(301, 400, 3), (500, 500, 1)]}
    assert formats.parse_partitions(formats.write_partitions(specs)) == specs
    for bad in ("FOO, a = 1-2", "DNA, a = 5-2", "DNA a = 1", "FOOX, a = 1"):
        with pytest.raises(ValueError):
            formats.parse_partitions(bad)


def test_structure_and_exclusions():
    assert formats.paired_sites("([.)]") == [(1, 4), (2, 5)]
    assert formats.parse_exclusions("3-5 9") == [(3, 5), (9, 9)]
    with pytest.raises(ValueError):
        formats.paired_sites("(()")


@pytest.mark.parametrize("kind", ["phylip", "fasta"])
def test_files_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame(SEQ, "taxon_id int, taxon string, seq string")
    readers.write_alignment(df, str(tmp_path / "w"), kind)
    got = readers.read_alignment(spark, str(tmp_path / "w"), kind).select("taxon_id", "taxon", "seq").orderBy("taxon_id")
    assert [tuple(r) for r in got.collect()] == SEQ
    readers.register(spark)
    df.repartition(3).write.format(kind).mode("append").save(str(tmp_path / "d"))
    assert [tuple(r) for r in spark.read.format(kind).load(str(tmp_path / "d")).orderBy("taxon_id").collect()] == SEQ


def test_tree_and_partition_files(spark, tmp_path):
    (tmp_path / "t.nwk").write_text("(a,b,\n(c,d));\n(a,c,(b,d));\n")
    assert [r.newick for r in readers.read_trees(spark, str(tmp_path / "t.nwk")).orderBy("pos").collect()] == ["(a,b, (c,d));", "(a,c,(b,d));"]
    (tmp_path / "p.txt").write_text("DNA, x = 1-10/2\n")
    assert readers.read_partitions(spark, str(tmp_path / "p.txt")).first().regions[0].stride == 2


def test_parameters_and_leaves():
    got = formats.parse_parameters("0.1 0.2 0.3 0.4\n0.05 3\n100 20 ms TN93\n1.5 2")
    assert got["freqs"] == (0.1, 0.2, 0.3, 0.4) and got["output"] == "MS" and got["numbers"] == (1.5, 2.0) and (got["sample"], got["piece"]) == (100, 20)
    for bad in ("", "0.1 0.2 0.3 0.5 0.05 3 100 20 ML F84 1", "0.1 0.2 0.3 0.4 0.05 3 100 20 ML GTR 1 2", "0.1 0.2 0.3 0.4 0.05 3 100 20 XX F84 1", "0.1 0.2 0.3 0.4 0.05 3 100 20 ML HKY 1"):
        with pytest.raises(ValueError):
            formats.parse_parameters(bad)
    assert formats.parse_leaves("(a:0.1,b:0.25);") == [("a", 0.1), ("b", 0.25)]
    with pytest.raises(ValueError):
        formats.parse_leaves("(a,b)")


@pytest.mark.parametrize("kind", ["phylip", "fasta"])
def test_blocks_go_to_files_of_their_own(spark, tmp_path, kind):
    rows = [(b, i, n, s[b * 3 : b * 3 + 3]) for b in range(2) for i, n, s in SEQ]
    readers.write_blocks(spark.createDataFrame(rows, "block int, taxon_id int, taxon string, seq string"), str(tmp_path / "b"), kind)
    got = readers.read_alignment(spark, str(tmp_path / "b"), kind).collect()
    assert len({r.file for r in got}) == 2
    assert sorted((r.file.split("block=")[1][0], r.taxon_id, r.taxon, r.seq) for r in got) == sorted((str(b), i, n, s) for b, i, n, s in rows)
