"""Matrix Market files and the random graph."""

import pytest
from pyspark.sql import functions as F

from meshwork.sources import matrix_market as M
from meshwork.sources.random_graph import random_graph

GENERAL = "%%MatrixMarket matrix coordinate real general\n% comment\n4 4 6\n1 1 5.0\n2 1 1.5\n1 2 9.0\n3 1 2.0\n4 3 0.5\n2 4 7.0\n"
SYMMETRIC = "%%MatrixMarket matrix coordinate real symmetric\n3 3 3\n1 1 5.0\n2 1 2.0\n3 2 4.0\n"


@pytest.fixture
def file(tmp_path):
    def make(text):
        path = tmp_path / "m.mtx"
        path.write_text(text)
        return str(path)

    return make


def rows(g):
    return sorted(tuple(r) for r in g.edges.collect())


def test_general(spark, file):
    g = M.read_mtx(spark, file(GENERAL))
    assert rows(g) == [(0, 1, 1.5), (0, 2, 2.0), (1, 0, 1.5), (2, 0, 2.0), (2, 3, 0.5), (3, 2, 0.5)]
    assert g.vertices.count() == 4
    assert (0, 0, 5.0) in rows(M.read_mtx(spark, file(GENERAL), lower_only=False))


def test_symmetric(spark, file):
    assert rows(M.read_mtx(spark, file(SYMMETRIC))) == [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)]
    assert (1, 2, 4.0) in rows(M.read_mtx(spark, file(SYMMETRIC), symmetric_weights=None))
    assert rows(M.read_mtx(spark, file(SYMMETRIC.replace("symmetric", "skew-symmetric")))) == rows(M.read_mtx(spark, file(SYMMETRIC)))
    with pytest.raises(M.MatrixMarketError):
        M.read_mtx(spark, file(SYMMETRIC.replace("3 3 3", "3 3 4")))


def test_odd_files(spark, file):
    assert rows(M.read_mtx(spark, file("%%MatrixMarket matrix coordinate pattern general\n3 3 2\n2 1\n3 1\n"))) == [(0, 1, 1.0), (0, 2, 1.0), (1, 0, 1.0), (2, 0, 1.0)]
    assert rows(M.read_mtx(spark, file("%%MatrixMarket matrix coordinate real general\n3 3 2\n2 1 1\n2 1 2\n"))) == [(0, 1, 3.0), (1, 0, 3.0)]
    assert rows(M.read_mtx(spark, file("%%MatrixMarket matrix coordinate real general\n3 3 2\n1 2 1\n1 3 2\n"))) == []
    with pytest.raises(Exception, match="(?i)path"):
        M.read_mtx(spark, "/nowhere.mtx")


def test_banner():
    assert M.parse_banner("%%MatrixMarket Matrix Coordinate Real General") == ("matrix", "coordinate", "real", "general")
    for bad in ("%%MatrixMarket matrix coordinate real", "%%Other matrix coordinate real general", "%%MatrixMarket matrix array pattern general", "%%MatrixMarket matrix coordinate real hermitian", "%%MatrixMarket matrix coordinate pattern skew-symmetric", "%%MatrixMarket vector coordinate real general"):
        with pytest.raises(M.MatrixMarketError):
            M.parse_banner(bad)


def test_codes():
    assert M.typecode("matrix", "coordinate", "real", "skew-symmetric") == "MCRK" and M.typecode_words("MAIG") == "matrix array integer general"
    assert [M.is_valid(c) for c in ("MCRG", "MAPG", "MCRH", "MCPK", "XCRG", "MCCH")] == [True, False, False, False, False, True]
    assert M.banner_line("array", "complex", "hermitian") == "%%MatrixMarket matrix array complex hermitian"
    assert (M.size_line(2, 3), M.size_line(2, 3, 4)) == ("2 3", "2 3 4")
    assert M.parse_size("2 3", "array") == (2, 3, None) and M.parse_size("2 3 4", "coordinate") == (2, 3, 4)
    codes = {}
    for line in ("%%MatrixMarket matrix coordinate", "%%Other matrix coordinate real general", "%%MatrixMarket matrix coordinate odd general", "%%MatrixMarket " + "x" * 2000):
        with pytest.raises(M.MatrixMarketError) as e:
            M.parse_banner(line)
        codes[line[:12]] = e.value.code
        assert e.value.code in range(11, 18)
    assert codes["%%Other matr"] == M.NO_HEADER
    for line in ("2 3", "a b c"):
        with pytest.raises(M.MatrixMarketError):
            M.parse_size(line, "coordinate")


def test_headers_and_complex_entries(spark, file, tmp_path):
    head = M.read_header(spark, file("%%MatrixMarket matrix array real general\n% c\n\n3 2\n1\n2\n"), strict=True)
    assert (head.format, head.rows, head.columns, head.entries) == ("array", 3, 2, None)
    with pytest.raises(M.MatrixMarketError):
        M.read_mtx(spark, file("%%MatrixMarket matrix array real general\n3 2\n1\n"))
    text = "%%MatrixMarket matrix coordinate complex general\n" + "% long comment\n" * 700 + "2 2 3\n2 2 3\n2 2 3\n1 2 0.5 -1\n"
    found = sorted(tuple(r) for r in M.read_entries(spark, file(text)).fillna(0.0).collect())
    assert found == [(0, 1, 0.5, -1.0), (1, 1, 3.0, 0.0), (1, 1, 3.0, 0.0)]
    folder = tmp_path / "parts"
    folder.mkdir()
    for name, part in (("a", "%%MatrixMarket matrix coordinate real general\n%\n"), ("b", "% more\n3 3 3\n2 1 1\n"), ("c", "3 3 3\n3 1 2\n")):
        (folder / name).write_text(part)
    assert sorted(tuple(r) for r in M.read_entries(spark, str(folder)).collect()) == [(1, 0, 1.0), (2, 0, 2.0), (2, 2, 3.0)]
    for empty in ("", "% only\n"):
        with pytest.raises(M.MatrixMarketError):
            M.read_header(spark, file(empty))


def test_write_and_read(spark, file, tmp_path):
    g = M.read_mtx(spark, file(GENERAL))
    for symmetry in ("general", "symmetric"):
        M.write_mtx(g.edges.repartition(3), str(tmp_path / symmetry), 4, symmetry=symmetry)
        assert rows(M.read_mtx(spark, str(tmp_path / symmetry), symmetric_weights=None)) == rows(g)
    M.write_mtx(g.edges, str(tmp_path / "p"), 4, field="pattern")
    assert M.read_entries(spark, str(tmp_path / "p")).agg(F.sum("w")).first()[0] == 6.0
    w = spark.createDataFrame([(1, 0, 1 / 3)], "src long, dst long, w double")
    M.write_mtx(w, str(tmp_path / "w"), 2)
    assert abs(M.read_entries(spark, str(tmp_path / "w")).first().w - 1 / 3) < 1e-16


def test_random_graph(spark):
    g = random_graph(spark, 40, 0.1, seed=3, symmetrize=False)
    found = [tuple(r) for r in g.edges.collect()]
    assert 90 < len(found) < 240 and all(1 <= w < 1.1 for _, _, w in found)
    assert sorted(found) == sorted(tuple(r) for r in random_graph(spark, 40, 0.1, seed=3, symmetrize=False).edges.repartition(3).collect())
    both = {(s, d): w for s, d, w in (tuple(r) for r in random_graph(spark, 40, 0.1, seed=3).edges.collect())}
    assert all(abs(both[d, s] - w) < 1e-12 for (s, d), w in both.items())
