import random

import pyarrow as pa
import pytest

from tessera import sinks
from tessera.sources import structures as S
from tessera.sources import tables as T

from . import plain_structures as plain


def atom(serial, chain, res_no, name="GLY", xyz=(0.0, 0.0, 0.0), kind="C", record="ATOM  "):
    x, y, z = xyz
    return f"{record}{serial:>5}  CA  {name:>3} {chain}{res_no:>4}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  5.25          {kind:>2}  "


REMARK = ["REMARK 350 BIOMOLECULE: 1", "REMARK 350 AUTHOR DETERMINED BIOLOGICAL UNIT: DIMERIC", "REMARK 350 APPLY THE FOLLOWING TO CHAINS: A, B"]
TWO = [atom(1, "A", 1, "ALA", (1.125, 2, 3), "N"), atom(2, "A", 2, "MSE"), atom(3, "B", 1, "SEP", kind="O1-"), atom(4, "B", 2, "XYZ")]


def parsed(*lines, **how):
    return plain.parse("\n".join(lines), S.StructureOptions(**how))


def test_two_chains():
    rows = parsed(*TWO)
    assert [(r[0], r[1], r[2], r[3], r[5]) for r in rows] == [(1, "A", 1, "ALA", "N"), (1, "A", 2, "MET", "C"), (2, "B", 1, "SER", "O1-"), (2, "B", 2, "UNKNOWN", "C")]
    assert rows[0][6:10] == (1.125, 2.0, 3.0, 5.25)
    assert parsed(*TWO, ignore_charge=True)[2][5] == "O"
    assert parsed(*TWO, x_start=29)[0][6] == 1.12


def test_dimer_remarks():
    assert len(parsed(*REMARK, *TWO, atom(9, "C", 1))) == 4  # C is no target
    with pytest.raises(plain.Rejected, match="dimer"):
        parsed(REMARK[0], *TWO)
    assert len(parsed(REMARK[0], *TWO, force_dimer=True)) == 4
    move = [f"REMARK 350   BIOMT{k}   1  {r}" for k, r in ((1, "0 1 0 10"), (2, "1 0 0 0"), (3, "0 0 1 -1"))]
    assert parsed(*REMARK, *move, *TWO, apply_biomt=True)[0][6:9] == (12.0, 1.125, 2.0)


@pytest.mark.parametrize("lines, why", [([*TWO, atom(9, "C", 1)], "two chains"), (TWO[:2], "1 chains"), (["ATOM      1"], "short"), ([TWO[0][:79]], "short"), ([TWO[0], "CONECT    1"], "CONECT"), ([atom(1, "A", 1, kind="")], "element"), ([TWO[0].replace("1.125", "1.x25")], "number")])
def test_rejects(lines, why):
    with pytest.raises(plain.Rejected, match=why):
        parsed(*lines)


def test_first_model_counts():
    assert len(parsed(*TWO, "ENDMDL", atom(5, "A", 9), atom(6, "Z", 9))) == 4
    with pytest.raises(plain.Rejected):
        parsed(TWO[0], "ENDMDL", *TWO)


def test_hetero_atoms_follow_bonds():
    het = [atom(10, "A", 50, "LIG", kind="ZN", record="HETATM"), atom(11, "A", 50, "LIG", kind="FE", record="HETATM"), atom(12, "A", 51, "HOH", kind="O", record="HETATM")]
    bonds = ["CONECT   10   11", "CONECT    2   10"]
    rows = {r[4]: r for r in parsed(*TWO, *het, *bonds)}
    assert rows[10][1:4] == rows[11][1:4] == ("A", 2, "MET") and 12 not in rows
    assert len(parsed(*TWO, *het, *bonds, ignore_hetatm=True)) == 4
    assert len(parsed(*TWO, *het, *bonds, "CONECT    1    2    3    4    5    6")) == 4  # too many fields: no bond counts


def test_insertion_codes_merge():
    twice = atom(5, "A", 1, "TRP").replace("   1    ", "   1A   ")
    assert {r[3] for r in parsed(*TWO, twice) if r[1:3] == ("A", 1)} == {"ALA"}


def cases():
    """Files of every kind of record, whole and broken, and random ones."""
    het = [atom(10, "A", 50, "LIG", kind="ZN", record="HETATM"), atom(11, "A", 50, "LIG", kind="FE", record="HETATM"), atom(12, "A", 51, "HOH", kind="O", record="HETATM")]
    move = [f"REMARK 350   BIOMT{k}   1  {r}" for k, r in ((1, "0 1 0 10"), (2, "1 0 0 0"), (3, "0 0 1 -1"))]
    yield from ([], [""], TWO, TWO[:2], [*TWO, atom(9, "C", 1)], [*REMARK, *TWO, atom(9, "C", 1)], [REMARK[0], *TWO], ["ATOM      1"], [TWO[0][:79]], [TWO[0], "CONECT    1"], [atom(1, "A", 1, kind="")])
    yield from ([TWO[0].replace("1.125", "1.x25")], [*TWO, "ENDMDL", atom(5, "A", 9), atom(6, "Z", 9)], [TWO[0], "ENDMDL", *TWO], [*REMARK, *move, *TWO], [*REMARK, move[0], *TWO], [*REMARK, "REMARK 350   BIOMT1   1  0 1 x", *TWO], [TWO[0], *REMARK, *TWO])
    yield from ([*TWO, *het, "CONECT   10   11", "CONECT    2   10"], [*TWO, *het, "CONECT    2   10", "CONECT    1    2    3    4    5    6"], [*TWO, *het, "ENDMDL", "CONECT   11   12", "CONECT    4   12"], ["REMARK 350 BIOMOLECULE: 2", REMARK[1], REMARK[2], *TWO], [*TWO, atom(5, "A", 1, "TRP").replace("   1    ", "   1A   ")])
    draw = random.Random(7)
    bodies = ["BIOMOLECULE: 1", "BIOMOLECULE:  2", "SOFTWARE DETERMINED QUATERNARY STRUCTURE: DIMERIC", "BIOLOGICAL UNIT: TETRAMERIC", "APPLY THE FOLLOWING TO CHAINS: A, B", "APPLY THE FOLLOWING TO CHAINS: B,C", *(m[10:] for m in move)]
    for _ in range(150):
        lines = [f"REMARK 350 {draw.choice(bodies)}" for _ in range(draw.choice((0, 0, 1, 8)))] if draw.random() < 0.5 else [*REMARK, *(move if draw.random() < 0.5 else [])]
        serials = range(1, draw.randint(4, 40))
        for s in serials:
            far = draw.random() < 0.5
            lines.append(atom(s - draw.choice((0,) * 30 + (1,)), draw.choice("AB" if draw.random() < 0.97 else "ABC"), draw.randint(1, 5), draw.choice(("ALA", "MSE", "SEP", "HOH")), (s, -s / 8, 0.5), draw.choice(("C", "N1+", "*", "ZN")), "HETATM" if far else "ATOM  "))
        bonds = [f"CONECT{draw.choice(serials):>5}" + "".join(f"{draw.choice(serials):>5}" for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(0, 30))]
        at = draw.randrange(len(lines) + 1)
        yield [*lines[:at], *(["ENDMDL"] if draw.random() < 0.2 else []), *lines[at:], *bonds]


@pytest.mark.parametrize("how", [{}, {"force_dimer": True, "ignore_charge": True}, {"apply_biomt": True, "x_start": 29}, {"ignore_hetatm": True}])
def test_columns_give_what_the_plain_program_gives(spark, how):
    options = S.StructureOptions(**how)
    files = [(f"f{k}", "\r\n".join(lines) if k % 2 else "\n".join(lines)) for k, lines in enumerate(cases())]
    expected, odd = [], {"null": "0 chains", "twice": "accession occurs more than once"}
    for name, text in files:
        try:
            expected += [(name, *row, None) for row in plain.parse(text, options)]
        except plain.Rejected as x:
            odd[name] = str(x)
    more = [("null", None), ("twice", "\n".join(TWO)), ("twice", "")]
    got = S.parse_structures(spark.createDataFrame(files + more, "complex_id string, value string").repartition(7), options).collect()
    assert {r.complex_id: r.reason for r in got if r.reason} == odd
    assert sorted(map(repr, (tuple(r) for r in got if not r.reason))) == sorted(map(repr, expected))
    assert any(r.hetero for r in got) != options.ignore_hetatm and len(expected) > 300


def test_directory(spark, tmp_path):
    (tmp_path / "1abc.pdb").write_text("\n".join(TWO))
    (tmp_path / "2abc_x.pdb").write_text("\n".join(TWO[:2]))
    (tmp_path / "3abc_1.pdb").write_text("\n".join(TWO))
    (tmp_path / "3abc_2.pdb").write_text("\n".join(TWO))
    (tmp_path / "4abc.txt").write_text("no")
    read = S.read_structures(spark, str(tmp_path))
    assert {r.complex_id for r in S.usable(read).collect()} == {"1abc"}
    assert {r.complex_id: r.reason for r in S.rejected(read).collect()} == {"2abc": "1 chains", "3abc": "accession occurs more than once"}
    assert {(r.side, r.sequence) for r in S.sequences(S.usable(read)).collect()} == {(1, "AM"), (2, "S")}


HEADER = "accession,structure_format,year,affinity_type,affinity_match,affinity_value,structure_pH,structure_Temperature"


def affinity(spark, tmp_path, *lines):
    p = tmp_path / "a.csv"
    p.write_text("\n".join([HEADER, *lines]) + "\n")
    return {r.accession: r for r in T.read_affinity(spark, str(p)).collect()}


def test_affinity(spark, tmp_path):
    rows = affinity(spark, tmp_path, '1abc,X-RAY=2.10,2009,Kd,=,1.10E-05,7.5,25 # a comment', "no comma here", '"2abc",NMR,2010,score,~,-3.5,,', "# all comment", "3abc,NMR,2011,IC50,<,1e-9,,300\r")
    assert abs(rows["1abc"].value + 11.4176) < 1e-4 and rows["1abc"].temperature == 298.15 and rows["1abc"].resolution == 2.1 and rows["1abc"].structure_type == "XRAY"
    assert rows["2abc"].value == -3.5 and rows["2abc"].ph is None and rows["3abc"].temperature == 300.0


@pytest.mark.parametrize("line", ["1a,NMR,2009,Kd,=,0,,", "1a,NMR,2009,Kx,=,1,,", "1a,FILM,2009,Kd,=,1,,", "1a,NMR,2009,Kd,!,1,,", "1a,NMR,2009,Kd,=,1", "1a,NMR,x,Kd,=,1,,", '1a,"NMR,2009,Kd,=,1,,'])
def test_affinity_fails(spark, tmp_path, line):
    with pytest.raises(Exception):  # noqa: B017  whatever error the engine wraps it in
        affinity(spark, tmp_path, line)


def test_scores(spark, tmp_path):
    (tmp_path / "s.csv").write_text("#c\n1abc,1.5,2\n2abc,3,4\n")
    assert {r.complex_id: list(r.scores) for r in T.read_scores(spark, str(tmp_path / "s.csv")).collect()} == {"1abc": [1.5, 2.0], "2abc": [3.0, 4.0]}
    (tmp_path / "r.sc").write_text("SEQUENCE: \nSCORE: total dG description\nSCORE: -1.5 2 1abc_0001\nSCORE: 3 4 2abc_0001\n")
    assert {r.complex_id: list(r.scores) for r in T.read_score_report(spark, str(tmp_path / "r.sc")).collect()} == {"1abc": [-1.5, 2.0], "2abc": [3.0, 4.0]}
    for bad in ("1abc,1\n2abc,1,2\n", "1abc,1\n1abc,2\n"):
        (tmp_path / "b.csv").write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            T.read_scores(spark, str(tmp_path / "b.csv")).collect()


def test_cluster_files(spark, tmp_path):
    p = tmp_path / "c"
    p.write_text("# head\n0.5:(a)(b)(c)\n1.25:(a,c)(b)\n(a,b,c)\n")
    read = T.read_clusters(spark, str(p))
    rows = {(r.clustering_id, r.complex_id): (r.min_dist, r.cluster_id) for r in read.collect()}
    assert rows[0, "b"] == (0.5, 1) and rows[1, "c"] == (1.25, 0) and rows[2, "b"] == (-1.0, 0)
    sinks.write_clusters(read.where("min_dist > 0"), str(tmp_path / "out"))
    again = T.read_clusters(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in read.where("min_dist > 0").collect()}
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_clusters(read, str(tmp_path / "out"))
    for bad in ("1:(a,b)(a)\n", "1:(a)(b)\n2:(a)\n", "1:(a,b\n"):
        p.write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            T.read_clusters(spark, str(p)).collect()


def test_declared_residues_and_open_access(spark, tmp_path):
    text = "SEQRES   1 A   15  ALA GLY TRP\nSEQRES   2 A   15  SER\nSEQRES   1 B    1  GLY\nATOM"
    out = S.declared_residues(spark.createDataFrame([("x", text), ("y", "ATOM"), ("z", None)], "complex_id string, value string")).collect()
    assert {(r.complex_id, r.chain): r.residues for r in out} == {("x", "A"): ["ALA", "GLY", "TRP", "SER"], ("x", "B"): ["GLY"]}
    (tmp_path / "oa.csv").write_text("PDB,PMCID\n1abc,PMC1\n\n2abc,PMC2\n")
    assert [tuple(r) for r in T.read_open_access(spark, str(tmp_path / "oa.csv")).orderBy("accession").collect()] == [("1abc", "PMC1"), ("2abc", "PMC2")]
    (tmp_path / "bad.csv").write_text("PDB,PMCID\n1abc,PMC1\n1abc,PMC2\n")
    with pytest.raises(Exception, match="occurs twice"):
        T.read_open_access(spark, str(tmp_path / "bad.csv")).collect()


def test_tables_of_several_files(spark, tmp_path):
    """Files with the header, without it, and with comments are one table; two headers fail."""
    head = "accession,structure_format,year,affinity_type,affinity_match,affinity_value"
    (tmp_path / "a").mkdir()
    for name, text in {"1.csv": f"# x\n{head}\n1abc,NMR,2001,Kd,=,1e-5\n", "2.csv": "2abc,NMR,2002,Ki,<,1e-6\r\n", "3.csv": f"{head}\n3abc,X-RAY=2.5,2003,score,~,-4 # y\n"}.items():
        (tmp_path / "a" / name).write_text(text)
    assert sorted((r.accession, r.year) for r in T.read_affinity(spark, str(tmp_path / "a")).collect()) == [("1abc", 2001), ("2abc", 2002), ("3abc", 2003)]
    (tmp_path / "a" / "4.csv").write_text("year," + head.replace(",year", "") + "\n")
    with pytest.raises(ValueError, match="different headers"):
        T.read_affinity(spark, str(tmp_path / "a"))


def test_cluster_files_of_many_tasks(spark, tmp_path):
    rows = [(k, float(k) + 0.5, i // (k + 1), f"m{i:02}") for k in range(23) for i in range(12)]
    members = spark.createDataFrame(rows, "clustering_id int, min_dist double, cluster_id int, complex_id string").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sinks.write_clusters(members, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(list((tmp_path / "out").glob("part-*"))) > 1
    got = {(r.clustering_id, r.min_dist, r.cluster_id, r.complex_id) for r in T.read_clusters(spark, str(tmp_path / "out")).collect()}
    assert got == set(rows)


def test_named_files(spark, tmp_path):
    """A file a name, whole and in order, whatever its lines; no overwriting; nothing of a
    job that fails; a task that comes twice leaves one file."""
    rows = spark.createDataFrame([("b/1", 2, "two"), ("a", 1, "x"), ("b/1", 1, "one"), ("b/1", 3, None)], "name string, at int, line string").repartition(4)
    sinks.write_named(rows, str(tmp_path / "out"), ".t", "head")
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.t": "head\nx\n", "b%2F1.t": "head\none\ntwo\n\n", "_SUCCESS": "2"}
    with pytest.raises(Exception, match="exists"):
        sinks.write_named(rows, str(tmp_path / "out"), ".t")
    with pytest.raises(Exception):  # noqa: B017  whatever error the engine wraps it in
        sinks.write_named(spark.createDataFrame([("a", 1, "x"), (None, 1, "x")], "name string, at int, line string"), str(tmp_path / "bad"), ".t")
    assert not (tmp_path / "bad").exists()
    sinks.write_named(rows.limit(0), str(tmp_path / "none"), ".t")
    assert [p.name for p in (tmp_path / "none").iterdir()] == ["_SUCCESS"]
    twice = sinks.NamedFilesWriter(str(tmp_path / "twice"), ".t", "")
    twice.claim()
    batch = pa.RecordBatch.from_pydict({"name": ["a", "a"], "line": ["1", "2"]})
    twice.commit([twice.write(iter([batch])), twice.write(iter([batch]))][:1])
    assert {p.name: p.read_text() for p in (tmp_path / "twice").iterdir()} == {"a.t": "1\n2\n", "_SUCCESS": "1"}


def test_folders_are_listed_once_and_not_read_as_files(spark, tmp_path):
    """Only files of the folder itself count, whatever its subfolders are called."""
    line = "ATOM  {n:5d}  CA  ALA {c}{n:4d}    " + "%8.3f%8.3f%8.3f" % (1, 2, 3) + "  1.00  5.25           C  "
    text = "\n".join(line.format(n=i + 1, c="AB"[i]) for i in range(2))
    (tmp_path / "old.pdb").mkdir()
    for name in ("1abc.pdb", "old.pdb/2def.pdb", "note.txt"):
        (tmp_path / name).write_text(text)
    got = S.read_structures(spark, str(tmp_path)).collect()
    assert sorted({(r.complex_id, r.reason) for r in got}) == [("1abc", None)] and len(got) == 2


def test_fields_of_any_letters(spark):
    """Lines with letters of several bytes, small letters and tabs give the plain rows."""
    small = [line.replace("ALA", "ala").replace("MSE", "mse")[:76] + "\tca " for line in TWO]
    files = [("a", "\n".join(TWO)), ("b", "\n".join(line.replace("CA", "Cé") for line in TWO)), ("c", "\n".join(small)), ("d", "\n".join(line[:76] + "éñ  " for line in TWO)), ("e", "\n".join(line[:31] + " 1e0 nan"[:7] + line[38:] for line in TWO))]
    got = S.parse_structures(spark.createDataFrame(files, "complex_id string, value string")).collect()
    want = [(name, *row, None) for name, text in files[:4] for row in plain.parse(text)]
    assert sorted(map(repr, (tuple(r) for r in got if not r.reason))) == sorted(map(repr, want))
    assert [(r.complex_id, r.reason) for r in got if r.reason] == [("e", "bad number at column 30")]


def test_structure_files_bring_a_complex_together_once(spark):
    """Atoms are shuffled once to be told apart, numbered and written to their file."""
    from tessera import catalogue

    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    n = catalogue.queries()["structure_files"](spark, "/root/testdata/sf0.01").count()
    assert shuffled() - before < 40 * n
