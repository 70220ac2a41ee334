"""A plain program for structure files, line by line, to compare with."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessera.functions.residues import LETTERS, MODIFIED, UNKNOWN
from tessera.sources.structures import MOST_BONDED, StructureOptions


class Rejected(Exception):
    pass


@dataclass
class Atom:
    chain: str
    res_no: int
    serial: int
    kind: str
    xyz: tuple[float, float, float]
    bfactor: float
    hetero: bool


def number(line: str, start: int, size: int, kind=float):
    try:
        return kind(line[start : start + size])
    except ValueError:
        raise Rejected(f"bad number at column {start}") from None


def residue_type(name: str) -> str:
    name = name.strip().upper()
    name = MODIFIED.get(name, name)
    return name if name in LETTERS else UNKNOWN


def bonded(line: str) -> list[int]:
    """The numbers of a CONECT line: five columns each, from column 6."""
    fields = [line[k : k + 5].strip() for k in range(6, len(line.rstrip()), 5)]
    numbers = [int(f) for f in fields if f.isdigit()]
    if len(numbers) < 2:
        raise Rejected("short CONECT")
    return numbers


def parse(text: str, options: StructureOptions = StructureOptions()) -> list[tuple]:
    """Atoms as (side, chain, res_no, res_type, serial, atom_type, x, y, z, bfactor, hetero).

    Of several models the first counts. REMARK 350 names the chains of biomolecule
    1, which must be marked a dimer; without it, chains are those of the atoms. A
    hetero atom bonded to a residue, over others if need be, becomes part of it.
    Exactly two chains must have atoms. Insertion codes and alternate locations are
    not told apart; a residue's type is that of its first atom.
    """
    remark, dimer, molecule, targets = False, False, 0, []
    moves: dict[str, list[list[float]]] = {}
    naming: list[str] = []
    atoms: list[Atom] = []
    types: dict[tuple[str, int], str] = {}
    pairs: set[tuple[int, int]] = set()
    overflow = False
    for line in text.splitlines():
        record = line[:6]
        if line.startswith("REMARK 350"):
            remark, body = True, line[10:]
            if m := re.search(r"BIOMOLECULE:\s*(\d+)", body):
                molecule = int(m[1])
            elif molecule == 1 and re.search(r"BIOLOGICAL UNIT:|QUATERNARY STRUCTURE:", body) and "DIMERIC" in body:
                dimer = True
            elif molecule == 1 and (m := re.search(r"APPLY THE FOLLOWING TO CHAINS:(.*)", body)):
                naming = [c.strip() for c in m[1].split(",") if c.strip()]
                if dimer or options.force_dimer:
                    targets += [c for c in naming if c not in targets]
            elif molecule == 1 and (m := re.search(r"BIOMT([123])\s+\d+\s+(.*)", body)):
                if options.apply_biomt:
                    try:
                        row = [float(v) for v in m[2].split()[:4]]
                        row[3]
                    except (ValueError, IndexError):
                        raise Rejected("bad BIOMT") from None
                    for c in naming:
                        moves.setdefault(c, []).append(row)
        elif record == "ENDMDL":
            chains = {a.chain for a in atoms if not a.hetero}
            if len(chains) != 2:
                raise Rejected("first model has not two chains")
            # Later models are passed over; bonds may still follow.
            for rest in text[text.index("ENDMDL") :].splitlines():
                if rest.startswith("CONECT"):
                    overflow |= _bonds(rest, pairs)
            break
        elif record == "CONECT":
            overflow |= _bonds(line, pairs)
        elif record in ("ATOM  ", "HETATM"):
            hetero = record == "HETATM"
            if len(line) < 54:
                raise Rejected("short line")
            chain = line[21]
            if remark and not dimer and not options.force_dimer:
                raise Rejected("not a dimer")
            if not hetero and remark and targets and chain not in targets:
                continue
            if len(line) < 80:
                raise Rejected("short line")
            kind = line[76:].strip().upper()
            if options.ignore_charge:
                kind = re.sub(r"[0-9+\-]+$", "", kind)
            if not kind:
                raise Rejected("no element")
            kind = UNKNOWN if kind == "*" else kind
            xyz = number(line, options.x_start, 38 - options.x_start if options.x_start > 29 else 8), number(line, 38, 8), number(line, 46, 8)
            atom = Atom(chain, number(line, 22, 4, int), number(line, 6, 5, int), kind, xyz, number(line, 60, 7) if line[60:67].strip() else 0.0, hetero)
            atoms.append(atom)
            if not hetero:
                types.setdefault((chain, atom.res_no), residue_type(line[17:20]))
                if not targets and len({a.chain for a in atoms if not a.hetero} if len(types) < 3 else {k[0] for k in types}) > 2:
                    raise Rejected("more than two chains")
    if overflow or len(atoms) > MOST_BONDED:
        pairs = set()
    owner = {} if options.ignore_hetatm else attached(atoms, pairs)
    kept = [(a, (a.chain, a.res_no)) for a in atoms if not a.hetero] + [(a, owner[a.serial]) for a in atoms if a.hetero and a.serial in owner]
    chains = sorted({key[0] for _, key in kept})
    if len(chains) != 2:
        raise Rejected(f"{len(chains)} chains")
    out = []
    for a, (chain, res_no) in kept:
        xyz = moved(a.xyz, moves[chain][:3]) if options.apply_biomt and len(moves.get(chain, ())) >= 3 else a.xyz
        out.append((chains.index(chain) + 1, chain, res_no, types[chain, res_no], a.serial, a.kind, *xyz, a.bfactor, a.hetero))
    return out


def moved(xyz: tuple[float, float, float], rows: list[list[float]]) -> tuple[float, float, float]:
    return tuple(sum(r[k] * xyz[k] for k in range(3)) + r[3] for r in rows)


def _bonds(line: str, pairs: set[tuple[int, int]]) -> bool:
    """Adds a line's bonds; whether it has more fields than the format allows."""
    first, *others = bonded(line)
    pairs.update((min(first, o), max(first, o)) for o in others)
    return len(others) > 4


def attached(atoms: list[Atom], pairs: set[tuple[int, int]]) -> dict[int, tuple[str, int]]:
    """The residue of each hetero atom that bonds lead to; the smallest pair decides."""
    owner = {a.serial: (a.chain, a.res_no) for a in atoms if not a.hetero}
    hetero = {a.serial for a in atoms if a.hetero} - owner.keys()
    found: dict[int, tuple[str, int]] = {}
    left, grown = sorted(pairs), True
    while grown:
        grown, rest = False, []
        for a, b in left:
            for one, two in ((a, b), (b, a)):
                if one in hetero and one not in found and (two in owner or two in found):
                    found[one] = owner.get(two) or found[two]
                    grown = True
                    break
            else:
                rest.append((a, b))
        left = rest
    return found
