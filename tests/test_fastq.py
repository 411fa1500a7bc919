import gzip
import random

import pytest

from strandloom.plans.pipeline import assemble_graph
from strandloom.sources import fastq
from strandloom.sources.fastq import FastqReader, read_fastq, write_fastq


def pair(i, rng):
    n, m = rng.randrange(1, 40), rng.randrange(1, 40)
    quality = lambda k: "".join(rng.choices("@+#!/12F", k=k))
    return (f"r{i}:x", "".join(rng.choices("ACGTN", k=n)), quality(n), "".join(rng.choices("acgt", k=m)), quality(m + rng.randrange(2)))


def text(pairs, end="\n"):
    return end.join(x for p in pairs for x in (f"@{p[0]}/1", p[1], "+", p[2], f"@{p[0]}/2", p[3], "+" + p[0], p[4]))


def split_read(path, size, **options):
    r = FastqReader({"path": str(path), "splitSize": str(size), **options})
    return [tuple(x.values()) for s in r.partitions() for b in r.read(s) for x in b.to_pylist()]


@pytest.fixture
def src():
    rng = random.Random(1)
    return [pair(i, rng) for i in range(12)]


def test_every_split_size_gives_every_pair_once(tmp_path, src):
    f = tmp_path / "a.fastq"
    f.write_text(text(src))
    for size in range(1, len(f.read_bytes()) + 2):
        assert split_read(f, size) == src, size


def test_small_blocks(tmp_path, monkeypatch, src):
    f = tmp_path / "a.fastq"
    f.write_text(text(src) + "\n")
    for n in (1, 3, 17, 64, 333):
        monkeypatch.setattr(fastq, "READ_BYTES", n)
        assert split_read(f, 1 << 20) == split_read(f, 200) == src


def test_line_ends_junk_and_compression(tmp_path, src):
    (tmp_path / "b.fastq").write_bytes(("junk\n@no/2\n" + text(src, "\r\n") + "\r\n\r\n").encode())
    assert split_read(tmp_path / "b.fastq", 100) == src
    (tmp_path / "c.fastq.gz").write_bytes(gzip.compress(text(src).encode()))
    assert split_read(tmp_path / "c.fastq.gz", 100) == src
    assert sorted(split_read(tmp_path, 100)) == sorted(src * 2)


def test_broken_ends(tmp_path, src):
    f = tmp_path / "d.fastq"
    f.write_text(text(src) + "\n@lone/1\nAC\n+\nFF\n")
    assert split_read(f, 1 << 20) == src
    f.write_text(text(src) + "\n@lone/1\nAC\n+\nFF\n@lone/2\nAC\n")
    with pytest.raises(ValueError, match="unexpected end"):
        split_read(f, 1 << 20)
    assert split_read(f, 1 << 20, mode="DROPMALFORMED") == src
    f.write_text("@x/1\nAC\n")
    assert split_read(f, 1 << 20) == []
    f.write_text("")
    assert split_read(f, 1 << 20) == []


def test_broken_record_and_long_lines(tmp_path, src):
    f = tmp_path / "e.fastq"
    lines = text(src).split("\n")
    f.write_text("\n".join(lines[:16] + ["stray"] + lines[16:]))
    with pytest.raises(ValueError, match="does not start"):
        split_read(f, 1 << 20)
    assert split_read(f, 1 << 20, mode="dropmalformed") == src
    with pytest.raises(ValueError, match="too long"):
        split_read(f, 1 << 20, maxLineLength="5")


def test_source_and_sink(spark, tmp_path, src):
    clean = [(i, f, "F" * len(f), r, "#" * len(r)) for i, f, _, r, _ in src]
    df = spark.createDataFrame(clean, fastq.SCHEMA)
    for packed in (None, "gzip"):
        path = str(tmp_path / f"out-{packed}")
        write_fastq(df.repartition(3), path, packed)
        assert sorted(tuple(r) for r in read_fastq(spark, path, splitSize=90).collect()) == sorted(clean)


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    g = "".join(rng.choices("ACGT", k=400))
    pairs = [(f"r-{i}", "N" * (i % 3) + g[10 * i : 10 * i + 48].lower(), "F", rc(g[10 * i + 52 : 10 * i + 99]), "F") for i in range(30)]
    pairs += [("short", "ACGT", "F", "ACGT", "F"), ("inner", "ACGTN" * 8, "F", "ACGTA" * 8, "F")]
    (tmp_path / "x.fastq").write_text(text(pairs))
    read = read_fastq(spark, str(tmp_path / "x.fastq"), splitSize=700)
    out = assemble_graph(read)
    assert out["reads"].count() == 31 and assemble_graph(read, odd="drop")["reads"].count() == 30 and {r["cov"] for r in out["reads"].collect()} == {2.0}
    full = assemble_graph(read, mode="full")
    edges = {tuple(r) for r in out["edges"].collect()}
    assert edges and edges == {tuple(r) for r in full["edges"].collect()} and out["digraph"].count() == len(edges)


@pytest.mark.parametrize("mode", ["canonical", "full"])
def test_ids_with_several_contents(spark, mode):
    rng = random.Random(4)
    g = ["".join(rng.choices("ACGT", k=60)) for _ in range(2)]
    far = lambda: "".join(rng.choices("ACGT", k=30))
    pairs = [("x/12", g[0][:40], "F", far(), "F"), ("x2", g[1][:40], "F", far(), "F"), ("a", g[0][10:50], "F", far(), "F"), ("b", g[1][10:50], "F", far(), "F")]
    pairs += pairs[:1]
    out = assemble_graph(spark.createDataFrame(pairs, fastq.SCHEMA), mode=mode)
    assert out["reads"].count() == 4
    edges = {(r["src"], r["dst"]) for r in out["edges"].collect()}
    assert edges == {("x2", "a"), ("a", "x2"), ("x2", "b"), ("b", "x2")}


def test_nodes_with_several_contents(spark, rows):
    from strandloom.operators.reads import usable_nodes

    s, t = "ACGT" * 6, "ACCT" * 6
    df = spark.createDataFrame([("a", s, s, 1.0), ("a", s, t, 2.0), ("a", s, s, None)], "id string, read_f string, read_r string, cov float")
    assert rows(usable_nodes(df)) == [("a", s, t, 2.0), ("a", s, s, 1.0)][:: 1 if t < s else -1]


def opened(path):
    return open(path.removeprefix("file:"), "rb")


def test_patterns_nested_folders_and_an_opener(spark, tmp_path, src):
    for i, at in enumerate(("a", "a/b", "c", ".hidden", "_logs")):
        (tmp_path / at).mkdir()
        (tmp_path / at / "x.fastq").write_text(text(src[4 * i : 4 * i + 4] or src))
    got = lambda p, **o: sorted(tuple(r) for r in read_fastq(spark, p, **o).collect())
    assert got(str(tmp_path), splitSize=50) == got(f"file://{tmp_path}") == got(f"{tmp_path}/a,{tmp_path}/c") == sorted(src)
    assert got(f"{tmp_path}/[bc]*/*.fastq") == sorted(src[8:]) and got(f"{tmp_path}/a") == sorted(src[:8])
    assert split_read(tmp_path / "c" / "x.fastq", 70, opener="test_fastq:opened") == src[8:]
    with pytest.raises(FileNotFoundError):
        read_fastq(spark, f"{tmp_path}/nothing*")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from strandloom.plans import pipeline

    rng = random.Random(3)
    g = "".join(rng.choices("ACGT", k=300))
    (tmp_path / "x.fastq").write_text(text([(f"r{i}", g[9 * i : 9 * i + 40], "F", g[9 * i + 60 : 9 * i + 100][::-1], "F") for i in range(20)]))
    pipeline.main(["-i", str(tmp_path / "x.fastq"), "-o", str(tmp_path / "out"), "--format", "tsv"])
    assert "reads: 20 rows" in capsys.readouterr().out
    edges = spark.read.option("sep", "\t").csv(str(tmp_path / "out" / "edges"))
    assert edges.count() > 0 and len(edges.columns) == 4
