"""Structures from CIF files.

Files are read by Spark as whole texts, so any store that Spark reads will do;
the parser handles full cells with symmetry operations, and the first block of
a file only.
"""

from __future__ import annotations

import re
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRUCTURE = """stem string, formula string, lattice array<array<double>>, sg_symbol string, sg_number int,
 sites array<struct<id:int,frac:array<double>,species:array<struct<symbol:string,occupancy:double,oxi_state:double,explicit:boolean>>>>, error string"""


def lattice_matrix(a, b, c, alpha, beta, gamma) -> np.ndarray:
    """Rows are the cell vectors; c along z, a in the xz plane."""
    al, be, ga = np.radians([alpha, beta, gamma])
    value = np.clip((np.cos(al) * np.cos(be) - np.cos(ga)) / (np.sin(al) * np.sin(be)), -1, 1)
    star = np.arccos(value)
    return np.array([[a * np.sin(be), 0, a * np.cos(be)], [-b * np.sin(al) * np.cos(star), b * np.sin(al) * np.sin(star), b * np.cos(al)], [0, 0, c]])


def _number(text: str) -> float:
    return float(re.sub(r"\(.*\)", "", text))


def _tokens(line: str) -> list[str]:
    return [a or b or c for a, b, c in re.findall(r"'([^']*)'|\"([^\"]*)\"|(\S+)", line)]


def _operation(text: str) -> tuple[np.ndarray, np.ndarray]:
    """'x+1/2, -y, z' as a matrix and a shift."""
    rot, shift = np.zeros((3, 3)), np.zeros(3)
    for i, part in enumerate(text.lower().replace(" ", "").split(",")):
        for sign, term in re.findall(r"([+-]?)([xyz]|\d+(?:/\d+|\.\d+)?)", part):
            s = -1 if sign == "-" else 1
            if term in "xyz":
                rot[i, "xyz".index(term)] = s
            else:
                shift[i] += s * float(Fraction(term))
    return rot, shift


def parse(text: str) -> dict:
    """The first structure of a CIF text."""
    items: dict[str, str] = {}
    loops: list[tuple[list[str], list[list[str]]]] = []
    lines = [x for x in (re.sub(r"\s#.*$", "", raw).strip() for raw in text.splitlines()) if x and not x.startswith("#")]
    k = 0
    blocks = 0
    while k < len(lines):
        line = lines[k]
        if line.lower().startswith("data_"):
            blocks += 1
            if blocks > 1:
                break
        elif line.lower() == "loop_":
            names, rows = [], []
            k += 1
            while k < len(lines) and lines[k].startswith("_"):
                names.append(lines[k].split()[0].lower())
                k += 1
            held: list[str] = []
            while k < len(lines) and not re.match(r"(_|loop_|data_)", lines[k], re.I):
                held += _tokens(lines[k])
                while len(held) >= len(names):
                    rows.append(held[: len(names)])
                    held = held[len(names) :]
                k += 1
            loops.append((names, rows))
            continue
        elif line.startswith("_"):
            t = _tokens(line)
            if len(t) > 1:
                items[t[0].lower()] = t[1]
        k += 1
    cell = [_number(items[f"_cell_{x}"]) for x in ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma")]
    matrix = lattice_matrix(*cell)
    table = lambda key: next((([*n], r) for n, r in loops if key in n), ([], []))
    oxidation: dict[str, float] = {}
    names, rows = table("_atom_type_oxidation_number")
    for r in rows:
        oxidation[r[names.index("_atom_type_symbol")]] = _number(r[names.index("_atom_type_oxidation_number")])
    names, rows = table("_symmetry_equiv_pos_as_xyz")
    key = "_symmetry_equiv_pos_as_xyz"
    if not rows:
        names, rows = table("_space_group_symop_operation_xyz")
        key = "_space_group_symop_operation_xyz"
    operations = [_operation(r[names.index(key)]) for r in rows] or [(np.eye(3), np.zeros(3))]
    names, rows = table("_atom_site_fract_x")
    if not rows:
        raise ValueError("no atom sites")
    at = {n: names.index(n) for n in names}
    sites: list[tuple[np.ndarray, dict[tuple[int, str], tuple[float, float | None]]]] = []
    for n, r in enumerate(rows):
        kind = r[at["_atom_site_type_symbol"]] if "_atom_site_type_symbol" in at else r[at["_atom_site_label"]]
        symbol = re.match(r"[A-Z][a-z]?", kind)[0]
        found = re.search(r"(\d*\.?\d*)([+-])$", kind)
        oxi = oxidation.get(kind, (float(found[1] or 1) * (1 if found[2] == "+" else -1)) if found else None)
        occupancy = _number(r[at["_atom_site_occupancy"]]) if "_atom_site_occupancy" in at and r[at["_atom_site_occupancy"]] not in ".?" else 1.0
        base = np.array([_number(r[at[f"_atom_site_fract_{x}"]]) for x in "xyz"])
        for rot, shift in operations:
            frac = (rot @ base + shift) % 1.0
            for place, species in sites:
                d = (place - frac + 0.5) % 1.0 - 0.5
                if np.linalg.norm(d @ matrix) < 0.01:
                    species.setdefault((n, symbol), (occupancy, oxi))
                    break
            else:
                sites.append((frac, {(n, symbol): (occupancy, oxi)}))
    out = [
        {"id": k, "frac": [float(x) for x in f], "species": [{"symbol": s, "occupancy": o, "oxi_state": 0.0 if x is None else x, "explicit": x is not None} for (_, s), (o, x) in sp.items()]}
        for k, (f, sp) in enumerate(sites)
    ]
    number = next((items[x] for x in ("_symmetry_int_tables_number", "_space_group_it_number") if x in items), None)
    symbol = next((items[x] for x in ("_symmetry_space_group_name_h-m", "_space_group_name_h-m_alt") if x in items), "")
    formula = items.get("_chemical_formula_structural") or items.get("_chemical_formula_sum", "").replace(" ", "")
    return {"formula": formula, "lattice": matrix.tolist(), "sg_symbol": symbol, "sg_number": int(number) if number and number.isdigit() else None, "sites": out}


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """One row for each CIF file: stem, the structure, and `error` for those that can't be parsed."""
    files = spark.read.text(path, wholetext=True).select(F.url_decode(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.cif)?$", 1)).alias("stem"), F.col("value").alias("text"))

    def rows(parts):
        for part in parts:
            out = []
            for stem, text in zip(part["stem"], part["text"]):
                try:
                    out.append({"stem": stem, **parse(text), "error": None})
                except Exception as e:  # a bad file is a row with its error
                    out.append({"stem": stem, "formula": None, "lattice": None, "sg_symbol": None, "sg_number": None, "sites": None, "error": f"{type(e).__name__}: {e}"[:200]})
            yield pd.DataFrame(out)

    return files.mapInPandas(rows, STRUCTURE)
