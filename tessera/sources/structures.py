"""Fixed-width structure files: one row for each atom of each two-chain complex.

Lines are rows with a file and a place. What a line means by its file's state (its
remarks, its first model, its chains) comes from one row for each file, joined back, so
a file may be as large as it likes and no Python worker reads it. A file that can't be
used gives a reason instead, never an exception: that of its first faulty line.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.residues import LETTERS, MODIFIED, UNKNOWN
from ..functions.text import accession, strip
from ..store import keep

SCHEMA = "complex_id string, side int, chain string, res_no int, res_type string, serial int, atom_type string, x double, y double, z double, bfactor double, hetero boolean, reason string"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
#: Fixed values of the format: bonded atoms are listed up to this number of atoms; an
#: atom bonds at most so many others.
MOST_BONDED, MOST_BONDS = 99_999, 4
FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


@dataclass(frozen=True)
class StructureOptions:
    """ignore_hetatm: attach no hetero atoms. ignore_charge: types without charges.
    force_dimer: take files not marked as dimers. x_start: 0-based column of x; 29
    repeats a reading that cuts off its last digit. apply_biomt: move chains by
    their transforms."""

    ignore_hetatm: bool = False
    ignore_charge: bool = False
    force_dimer: bool = False
    x_start: int = 30
    apply_biomt: bool = False


def plain(lines: DataFrame) -> DataFrame:
    """`lines` with their bytes, and whether a character is a byte."""
    return lines.withColumns({"bytes": F.col("line").cast("binary"), "plain": F.octet_length("line") == F.length("line")})


def part(start: int, size: int | None = None) -> Column:
    """The columns of a line from `start`, counted from 0; of a plain one without going
    through those before."""
    at, size = start + 1, size or 2**31 - 1 - start
    return F.when(F.col("plain"), F.substring("bytes", at, size).cast("string")).otherwise(F.substring("line", at, size))


def field(start: int, size: int | None = None) -> Column:
    """As `part`, without white space at either end; ASCII needs no pattern for that."""
    c = part(start, size)
    return F.when(F.col("plain"), F.btrim(c, F.lit(" \t\n\x0b\f\r"))).otherwise(strip(c))


def residue_type(name: Column) -> Column:
    """The standard name of a residue in capitals, modified ones by their parents; else
    unknown."""
    parents = F.create_map(*[F.lit(v) for kv in MODIFIED.items() for v in kv])
    name = F.coalesce(parents[name], name)
    return F.when(name.isin(*LETTERS), name).otherwise(UNKNOWN)


def before(place: Column, pos: Column) -> Column:
    """Whether `place`, null if there is none, lies before `pos`."""
    return F.coalesce(place < pos, F.lit(False))


def records(lines: DataFrame, options: StructureOptions) -> DataFrame:
    """The lines that count, taken apart once: `record`, the text of remarks, the numbers of
    bonds, the fields of atoms. `reason` says what is wrong with a line whatever its file;
    of atoms, only those of a chain that counts need more than 54 columns."""
    atom = F.col("head").isin("ATOM  ", "HETATM")
    remark = F.startswith("line", F.lit("REMARK 350"))
    wanted = lines.withColumn("head", F.substring("line", 1, 6)).where(remark | F.col("head").isin("ENDMDL", "CONECT") | atom)
    wanted = plain(wanted).withColumns({"kind": field(76), "name": field(17, 3)})
    # Most names are in capitals, and known.
    kind = F.when((F.length("kind") == 1) & F.col("kind").between("A", "Z"), F.col("kind")).otherwise(F.upper("kind"))
    name = F.when(F.col("name").isin(*LETTERS, *MODIFIED), F.col("name")).otherwise(F.upper("name"))
    if options.ignore_charge:
        kind = F.regexp_replace(kind, r"[0-9+\-]+$", "")
    x = (options.x_start, 38 - options.x_start if options.x_start > 29 else 8)
    numbers = {"x": (*x, "double"), "y": (38, 8, "double"), "z": (46, 8, "double"), "res_no": (22, 4, "int"), "serial": (6, 5, "int"), "bfactor": (60, 7, "double")}
    # Names of numbers, and signs of their types, are read by the engine but not meant here.
    # Most lines have no such letter in any number, which one look tells.
    letter = "[A-DF-Za-df-z]"
    lettered = F.concat(part(6, 5), part(22, 4), part(options.x_start, 67 - options.x_start)).rlike(letter)
    read = {n: part(start, width).try_cast(t) for n, (start, width, t) in numbers.items()}
    # Fields that are used more than once are columns first, so that each is worked out once.
    wanted = wanted.select("complex_id", "pos", "line", "bytes", "plain", "head", kind.alias("kind"), name.alias("name"), lettered.alias("lettered"), *[c.alias(n) for n, c in read.items()])
    unread = {n: F.col(n).isNull() | (F.col("lettered") & part(start, width).rlike(letter)) for n, (start, width, _) in numbers.items()}
    unread["bfactor"] = unread["bfactor"] & (strip(part(60, 7)) != "")
    size = F.length("line")
    reason = F.when(size < 80, "short line").when(F.col("kind") == "", "no element")
    for n, wrong in unread.items():
        reason = reason.when(wrong, f"bad number at column {numbers[n][0]}")
    fields = F.transform(F.regexp_extract_all(F.regexp_replace(part(6), r"\s+$", ""), F.lit("(.{1,5})"), 1), strip)
    bonded = F.when(F.col("head") == "CONECT", F.transform(F.filter(fields, lambda f: f.rlike(r"^\d+$")), lambda f: f.cast("int")))
    of_atom = {"hetero": F.col("head") == "HETATM", "chain": part(21, 1), "res_type": residue_type(F.col("name")), "atom_type": F.when(F.col("kind") == "*", UNKNOWN).otherwise(F.col("kind")), **{n: F.col(n) for n in numbers}, "bfactor": F.coalesce("bfactor", F.lit(0.0)), "stub": size < 54}
    remark = F.startswith("line", F.lit("REMARK"))
    return wanted.select("complex_id", "pos", F.when(remark, "REMARK").when(atom, "ATOM").otherwise(F.col("head")).alias("record"), F.when(remark, part(10)).alias("body"), bonded.alias("bonded"), *[F.when(atom, c).alias(n) for n, c in of_atom.items()], F.when(atom, reason).when(F.size(bonded) < 2, "short CONECT").alias("reason"))


def file_states(rows: DataFrame, options: StructureOptions) -> DataFrame:
    """A row for each file with remarks or models: where the first REMARK 350, the mark of
    a dimer and ENDMDL stand, and the chains granted by lines for biomolecule 1.

    Chains count if the mark stands before them, or with `force_dimer`."""
    w = Window.partitionBy("complex_id").orderBy("pos")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    body = F.coalesce("body", F.lit(""))
    told = F.regexp_extract(body, r"BIOMOLECULE:\s*(\d+)", 1)
    listed = F.filter(F.transform(F.split(F.regexp_extract("body", "APPLY THE FOLLOWING TO CHAINS:(.*)", 1), ","), strip), lambda c: c != "")
    said = rows.where(F.col("record").isin("REMARK", "ENDMDL")).select("complex_id", "pos", (F.col("record") == "REMARK").alias("remark"), body.alias("body"), told.alias("told"))
    said = said.withColumn("first", (F.col("told") == "") & F.coalesce(F.last(F.when(F.col("told") != "", F.col("told").rlike("^0*1$")), ignorenulls=True).over(w), F.lit(False)))
    said = said.withColumn("unit", F.col("first") & F.col("body").rlike("BIOLOGICAL UNIT:|QUATERNARY STRUCTURE:") & F.contains("body", F.lit("DIMERIC")))
    said = said.withColumn("names", F.when(F.col("first") & ~F.col("unit") & F.contains("body", F.lit("APPLY THE FOLLOWING TO CHAINS:")), listed))
    marked = F.lit(True) if options.force_dimer else F.coalesce(F.max("unit").over(earlier), F.lit(False))
    said = said.withColumns({"granted": marked & (F.size("names") > 0), "naming": F.last("names", ignorenulls=True).over(w)})
    numbers = F.slice(F.split(strip(F.regexp_extract("body", r"BIOMT[123]\s+\d+\s+(.*)", 1)), r"\s+"), 1, 4)
    moves = F.col("first") & ~F.col("unit") & F.col("names").isNull() & F.col("body").rlike(r"BIOMT[123]\s+\d+\s+")
    bad = moves & ~((F.size(numbers) == 4) & F.forall(numbers, lambda v: v.rlike(FLOAT)))
    said = said.withColumns({"move": F.when(moves & ~bad, F.transform(numbers, lambda v: v.try_cast("double"))), "bad": bad})
    move = F.struct("pos", "naming", "move")
    return said.groupBy("complex_id").agg(
        F.min(F.when(F.col("remark"), F.col("pos"))).alias("remark_pos"),
        F.min(F.when(F.col("unit"), F.col("pos"))).alias("dimer_pos"),
        F.min(F.when(~F.col("remark"), F.col("pos"))).alias("end_pos"),
        F.collect_list(F.when(F.col("granted"), F.struct("pos", "names"))).alias("grants"),
        *([F.array_sort(F.collect_list(F.when(F.col("move").isNotNull(), move))).alias("moves"), F.min(F.when(F.col("bad"), F.col("pos"))).alias("bad_pos")] if options.apply_biomt else []),
    )


ATOM = ["complex_id", "pos", "hetero", "chain", "res_no", "res_type", "serial", "atom_type", "x", "y", "z", "bfactor"]


def atom_lines(rows: DataFrame, states: DataFrame, options: StructureOptions, how: str = "left") -> DataFrame:
    """The atoms that count by their file's state, and what is wrong with them."""
    rows = rows.where("record = 'ATOM'").join(states, "complex_id", how)
    pos = F.col("pos")
    remark = before(F.col("remark_pos"), pos)
    gated = F.lit(False) if options.force_dimer else remark & ~before(F.col("dimer_pos"), pos)
    granted = F.filter(F.coalesce("grants", F.array()), lambda g: g["pos"] < pos)
    passed = ~F.col("hetero") & remark & (F.size(granted) > 0) & ~F.exists(granted, lambda g: F.array_contains(g["names"], F.col("chain")))
    reason = F.when(F.col("stub"), "short line").when(gated, "not a dimer").otherwise(F.col("reason"))
    counted = rows.where((F.col("end_pos").isNull() | (pos < F.col("end_pos"))) & (F.col("stub") | gated | ~passed))
    return counted.select(*ATOM, reason.alias("reason"))


def verdicts(files: DataFrame, rows: DataFrame, states: DataFrame, options: StructureOptions) -> DataFrame:
    """A row for each file: its state, the chains present, whether its bonds count,
    and the reason why it can't be used, if any. Bonds after the first model count too.

    A third chain is a fault unless remarks have granted chains before."""
    atoms = atom_lines(rows, states, options).select("complex_id", "pos", "reason", F.when(~F.col("hetero") & F.col("reason").isNull(), F.col("chain")).alias("chain"), F.lit(1).alias("atom"), F.lit(False).alias("overfull"))
    bonds = rows.where("record = 'CONECT'").select("complex_id", "pos", "reason", F.lit(None).cast("string").alias("chain"), F.lit(0).alias("atom"), (F.size("bonded") > MOST_BONDS + 1).alias("overfull"))
    at = F.when(F.col("reason").isNotNull(), F.col("pos"))
    chains = atoms.unionByName(bonds).groupBy("complex_id", "chain").agg(F.min(at).alias("fault_pos"), F.min_by("reason", at).alias("fault"), F.sum("atom").alias("atoms"), F.max("overfull").alias("overfull"), F.min("pos").alias("first"))
    each = chains.groupBy("complex_id").agg(F.min("fault_pos").alias("fault_pos"), F.min_by("fault", "fault_pos").alias("fault"), F.sum("atoms").alias("atoms"), F.max("overfull").alias("overfull"), F.array_sort(F.collect_list(F.when(F.col("chain").isNotNull(), F.struct("first", "chain")))).alias("chains"))
    all_ = files.groupBy("complex_id").agg(F.count("*").alias("files")).join(each, "complex_id", "left").join(states, "complex_id", "left")
    all_ = all_.withColumn("chains", F.coalesce("chains", F.array()))
    n, third = F.size("chains"), F.get("chains", F.lit(2))["first"]
    free = ~F.exists(F.coalesce("grants", F.array()), lambda g: g["pos"] < third)
    found = [fault_at(F.col("fault_pos"), F.col("fault")), fault_at(F.when(free, third), "more than two chains"), fault_at(F.when(n != 2, F.col("end_pos")), "first model has not two chains")]
    if options.apply_biomt:
        found.append(fault_at(F.col("bad_pos"), "bad BIOMT"))
    first = F.array_min(F.array_compact(F.array(*found)))["reason"]
    reason = F.when(F.col("files") > 1, "accession occurs more than once").otherwise(F.coalesce(first, F.when(n != 2, F.concat(n.cast("string"), F.lit(" chains")))))
    bonded = ~F.coalesce("overfull", F.lit(False)) & (F.coalesce("atoms", F.lit(0)) <= MOST_BONDED)
    all_ = all_.withColumns({"reason": reason, "bonded_count": bonded, "present": F.transform("chains", lambda c: c["chain"])})
    return all_.select(*states.columns, "present", "bonded_count", "reason")


def fault_at(pos: Column, why: str | Column) -> Column:
    return F.when(pos.isNotNull(), F.struct(pos.alias("pos"), (F.lit(why) if isinstance(why, str) else why).alias("reason")))


def attached(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(complex_id, serial, chain, res_no): the residue that bonds lead each hetero atom to.

    Bonds, sorted, are gone through again and again, and one with a reached end reaches
    the other. So an atom's label is the earliest (pass, bond) that reaches it, and one
    label leads to the next: rounds of joins in which only atoms with new labels take
    part, until none is. Of labels for one place the latest counts, as the atom they come
    from may have got another residue meanwhile. A lost executor costs one round at most."""
    key = ["complex_id", "serial"]
    owners = atoms.where("not hetero").groupBy(*key).agg(F.max_by(F.struct("chain", "res_no"), "pos").alias("residue"))
    free = atoms.where("hetero").select(*key).distinct().join(owners, key, "left_anti")
    ends = bonds.select("complex_id", F.col("bonded")[0].alias("one"), F.explode(F.expr("slice(bonded, 2, size(bonded))")).alias("two"))
    both = ends.unionByName(ends.select("complex_id", F.col("two").alias("one"), F.col("one").alias("two"))).distinct()
    edges = keep(both.withColumnRenamed("one", "serial").join(free, key).select(*key, F.col("two").alias("by"), F.struct(F.least("serial", "two").alias("a"), F.greatest("serial", "two").alias("b")).alias("bond")))
    known = owners.withColumnRenamed("serial", "by")
    label, count = F.struct(F.lit(1).alias("turn"), "bond", F.lit(0).alias("age"), "residue").alias("label"), 0
    best = keep(edges.join(known, ["complex_id", "by"]).groupBy(*key).agg(F.min(label).alias("label")).withColumn("fresh", F.lit(True)))
    inner = edges.join(free.withColumnRenamed("serial", "by"), ["complex_id", "by"], "left_semi")
    if inner.isEmpty():
        return best.select(*key, "label.residue.*")
    inner = keep(inner)
    while not best.where("fresh").isEmpty():
        news = best.where("fresh").select("complex_id", F.col("serial").alias("by"), "label")
        count += 1
        turn = F.col("label.turn") + F.when(F.col("label.bond") < F.col("bond"), 0).otherwise(1)
        reached = inner.join(news, ["complex_id", "by"]).select(*key, F.struct(turn.alias("turn"), "bond", F.lit(-count).alias("age"), "label.residue").alias("label"), F.lit(None).alias("old"))
        all_ = best.select(*key, "label", F.col("label").alias("old")).union(reached)
        least = all_.groupBy(*key).agg(F.min("label").alias("label"), F.min("old").alias("old"))
        same = reduce(lambda a, b: a & b, [F.col(f"old.{c}").eqNullSafe(F.col(f"label.{c}")) for c in ("turn", "bond", "residue")])
        best = keep(least.select(*key, "label", (~same).alias("fresh")))
    return best.select(*key, "label.residue.*")


def moved(rows: DataFrame) -> DataFrame:
    """Atoms moved by the first three lines of the transform that names their chain."""
    of_chain = F.slice(F.filter(F.coalesce("moves", F.array()), lambda m: F.array_contains(m["naming"], F.col("chain"))), 1, 3)
    rows = rows.withColumn("by", F.transform(of_chain, lambda m: m["move"]))
    place = {c: F.when(F.size("by") == 3, reduce(lambda a, b: a + b, [F.col("by")[k][i] * F.col(a) for i, a in enumerate("xyz")]) + F.col("by")[k][3]).otherwise(F.col(c)) for k, c in enumerate("xyz")}
    return rows.withColumns(place)


def structures(files: DataFrame, lines: DataFrame, options: StructureOptions) -> DataFrame:
    """Atoms of files (complex_id) with lines (complex_id, pos, line); `pos` orders the
    lines of a file.

    Of several models the first counts. REMARK 350 names the chains of biomolecule
    1, which must be marked a dimer; without it, chains are those of the atoms. A
    hetero atom bonded to a residue, over others if need be, becomes part of it.
    Exactly two chains must have atoms. Insertion codes and alternate locations are
    not told apart; a residue's type is that of its first atom. A null text, and an
    empty one, has no chains; numbers are plain decimals."""
    lines = keep(records(lines, options))
    told = keep(verdicts(files, lines, file_states(lines, options), options))
    good = told.where("reason is null")
    atoms = atom_lines(lines, good.drop("reason", "present"), options, "inner").drop("reason")
    rows = atoms.where("not hetero")
    if not options.ignore_hetatm:
        bonds = lines.where("record = 'CONECT'").join(good.where("bonded_count"), "complex_id", "left_semi")
        if not bonds.isEmpty():
            owners = attached(atoms, bonds)
            rows = rows.unionByName(atoms.where("hetero").drop("chain", "res_no").join(owners, ["complex_id", "serial"]))
    residue = Window.partitionBy("complex_id", "chain", "res_no")
    own = ~F.col("hetero")
    rows = rows.withColumn("res_type", F.min_by(F.when(own, F.col("res_type")), F.when(own, F.col("pos"))).over(residue))
    rows = rows.join(good.select("complex_id", "present", *(["moves"] if options.apply_biomt else [])), "complex_id")
    if options.apply_biomt:
        rows = moved(rows)
    side = F.when(F.col("chain") == F.array_min("present"), 1).otherwise(2)
    out = rows.withColumns({"side": side, "reason": F.lit(None).cast("string")}).select(*NAMES)
    return out.unionByName(told.where("reason is not null").select("complex_id", "reason"), allowMissingColumns=True)


def read_structures(spark: SparkSession, path: str, options: StructureOptions = StructureOptions()) -> DataFrame:
    """Atoms of all `*.pdb` files in `path`, `complex_id` from the name; a file that is
    left out gives one row with only complex_id and reason. Two files of one accession
    are both left out."""
    # A filter of one listing; a pattern in the path would make each file a path of its own.
    every = lambda form: spark.read.format(form).option("pathGlobFilter", "*.pdb").load(path)
    name = accession(F.col("_metadata.file_name")).alias("complex_id")
    files = every("binaryFile").select(name)
    lines = every("text").select(name, F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("pos"), F.col("value").alias("line"))
    return structures(files, lines, options)


def parse_structures(files: DataFrame, options: StructureOptions = StructureOptions()) -> DataFrame:
    """As `read_structures`, of rows (complex_id, value)."""
    lines = files.select("complex_id", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("pos", "line"))
    return structures(files.select("complex_id"), lines, options)


def usable(atoms: DataFrame) -> DataFrame:
    return atoms.where("reason is null").drop("reason")


def rejected(atoms: DataFrame) -> DataFrame:
    return atoms.where("reason is not null").select("complex_id", "reason")


def declared_residues(files: DataFrame) -> DataFrame:
    """(complex_id, chain, residues): the three-letter names that SEQRES lines of rows
    (complex_id, value) give each chain, in order."""
    lines = files.select("complex_id", F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).where(F.startswith("line", F.lit("SEQRES")))
    names = F.filter(F.split(F.trim(F.substring("line", 20, 51)), r"\s+"), lambda x: x != "")
    each = lines.select("complex_id", F.substring("line", 12, 1).alias("chain"), F.struct("at", names.alias("names")).alias("part"))
    return each.groupBy("complex_id", "chain").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["names"])).alias("residues"))


def sequences(atoms: DataFrame) -> DataFrame:
    """(complex_id, side, sequence): one letter for each known residue, by number."""
    letters = F.create_map(*[F.lit(v) for kv in LETTERS.items() for v in kv])
    residues = atoms.select("complex_id", "side", "res_no", letters[F.col("res_type")].alias("letter")).distinct()
    ordered = F.array_sort(F.collect_list(F.when(F.col("letter").isNotNull(), F.struct("res_no", "letter"))))
    return residues.groupBy("complex_id", "side").agg(F.array_join(F.transform(ordered, lambda r: r["letter"]), "").alias("sequence"))
