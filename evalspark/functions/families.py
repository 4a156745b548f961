"""Feature families: which are selected, what they are called, and their columns side by side."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Family keys with their labels, and other spellings of the keys.
LABELS = {
    "morgan": "Morgan fingerprints",
    "ecfp6": "ECFP6 fingerprints",
    "fcfp6": "FCFP6 fingerprints",
    "layered": "RDKit layered fingerprints",
    "atom_pair": "Atom-pair fingerprints",
    "topological_torsion": "Topological torsion fingerprints",
    "rdk_path": "RDKit path fingerprints",
    "maccs": "MACCS keys",
    "rdkit": "RDKit descriptors",
    "maplight": "MapLight classic (Morgan + Avalon + ErG + chosen descriptors)",
}
ALIASES = {
    "layeredfp": "layered",
    "rdk": "rdk_path",
    "rdkfp": "rdk_path",
    "atompair": "atom_pair",
    "topologicaltorsion": "topological_torsion",
    "topo_torsion": "topological_torsion",
    "tt": "topological_torsion",
}


def selected_families(names: Iterable[object], flagged: Iterable[str] = (), known: Iterable[str] = tuple(LABELS),
                      aliases: Mapping[str, str] = ALIASES) -> list[str]:
    """Known families in the order first named, then those that only a flag asks for; unknown names are left out."""
    plain = [str(n).strip().lower() for n in names]
    asked = [aliases.get(n, n) for n in plain] + list(flagged)
    known = set(known)
    return [n for n in dict.fromkeys(asked) if n in known]


def family_columns(df: DataFrame, keep: list[str], builders: Mapping[str, Column], selected: Iterable[str]) -> DataFrame:
    """``keep`` plus one array ``features``: the arrays of the selected families one after another, in that order.

    ``widths`` gives each family's number of entries, so that a position can be traced back to its family. A missing array
    makes the row's features null.
    """
    selected = list(selected)
    for name in selected:
        if name not in builders:
            raise ValueError(f"unsupported feature family: {name}")
    if not selected:
        raise ValueError("no feature family is selected")
    parts = [builders[n].cast("array<double>") for n in selected]
    widths = F.create_map(*[c for n, p in zip(selected, parts) for c in (F.lit(n), F.size(p))])
    return df.select(*keep, F.concat(*parts).alias("features"), widths.alias("widths"))
