"""Settings of a run: nested frozen dataclasses, read from JSON, with dotted overrides; unknown names are refused."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any, get_type_hints


@dataclass(frozen=True)
class Gates:
    min_coverage: float = 0.9
    coverage_excludes_3p_clip: bool = True
    min_identity: float = 0.95
    max_5p_clip: int = 200
    max_3p_clip: int | None = None
    min_mapq: int = 0
    min_intron: int = 20
    max_intron: int = 500_000
    max_rejected: float = 0.5
    min_reads_for_check: int = 50_000


@dataclass(frozen=True)
class Junctions:
    tolerance: int = 5
    min_umis: int = 3
    min_reads: int = 5
    min_share: float = 0.001
    max_lfdr: float = 0.05
    conditional_libraries: int = 2
    conditional_reads: int = 50
    repeat_len: int = 8
    min_gap_reads: int = 3
    max_gap_len: int = 5000
    min_sr_reads: int = 2
    min_sr_overhang: int = 10
    min_sr_libraries: int = 2
    holdout_share: float = 0.5
    rescue: bool = False


@dataclass(frozen=True)
class Chains:
    min_umis: int = 3
    min_reads: int = 5
    min_share: float = 0.01
    debris_ratio: float = 0.33
    dominant_ratio: float = 3.0
    tss_distance: int = 100


@dataclass(frozen=True)
class Ends:
    peak_window: int = 30
    max_5p_diff: int = 100
    percentile: float = 90.0
    min_umis: int = 3
    min_reads: int = 5
    min_share: float = 0.05
    max_fallback: int = 300
    max_variants: int = 3
    min_tail_len: int = 8
    min_tail_share: float = 0.3
    emit_unresolved: bool = False


@dataclass(frozen=True)
class Terminal:
    sibling_ratio: float = 2.0
    max_distance: int = 5000
    max_dispersion: float = 12.0
    min_candidate_share: float = 0.3


@dataclass(frozen=True)
class Coverage:
    window: int = 100
    max_downstream_ratio: float = 0.3
    min_coverage: float = 3.0


@dataclass(frozen=True)
class Monoexon:
    enabled: bool = True
    peak_window: int = 100
    min_overlap: float = 0.5
    min_umis: int = 3
    min_reads: int = 5
    intergenic_reads: int = 10
    max_percent_a: float = 60.0


@dataclass(frozen=True)
class Scoring:
    enabled: bool = True
    min_anchors: int = 50
    l2: float = 1.0
    bins: int = 60
    smooth: int = 5


@dataclass(frozen=True)
class Molecules:
    normalise: str = "none"
    hamming: int = 1


@dataclass(frozen=True)
class SecondPass:
    enabled: bool = True
    remove_classes: tuple[str, ...] = ("C", "D", "E")
    min_intron_overlap: int = 10
    min_tail_excess: int = 8
    min_nontemplated: float = 0.5
    min_contrast: float = 0.1
    max_dispersion: float = 12.0
    dominance_ratio: float = 1.0


@dataclass(frozen=True)
class Posthoc:
    enabled: bool = True
    end3_tolerance: int = 200
    end5_window: int = -1
    subchain_ratio: float = 2.0
    subchain_fuzzy: int = 5
    subchain_slack: int = 50
    protected: tuple[str, ...] = ("FSM", "INFERRED")


@dataclass(frozen=True)
class Config:
    alignments: str = ""
    annotation: str = ""
    genome: str | None = None
    umis: str | None = None
    junction_tables: tuple[str, ...] = ()
    polya_sites: str | None = None
    coverage_tracks: tuple[str, ...] = ()
    out: str = "catalogue"
    contigs: tuple[str, ...] = ()
    exclude_contigs: tuple[str, ...] = ("chrM", "MT", "M")
    strict: bool = True
    gates: Gates = field(default_factory=Gates)
    junctions: Junctions = field(default_factory=Junctions)
    chains: Chains = field(default_factory=Chains)
    ends: Ends = field(default_factory=Ends)
    terminal: Terminal = field(default_factory=Terminal)
    coverage: Coverage = field(default_factory=Coverage)
    monoexon: Monoexon = field(default_factory=Monoexon)
    scoring: Scoring = field(default_factory=Scoring)
    molecules: Molecules = field(default_factory=Molecules)
    secondpass: SecondPass = field(default_factory=SecondPass)
    posthoc: Posthoc = field(default_factory=Posthoc)

    def check(self) -> Config:
        """self, or ValueError naming every setting that makes no sense."""
        wrong = []
        for name, low, high in (("gates.min_coverage", 0, 1), ("gates.min_identity", 0, 1), ("junctions.min_share", 0, 1), ("chains.min_share", 0, 1), ("ends.percentile", 0, 100), ("ends.min_share", 0, 1), ("junctions.holdout_share", 0, 1)):
            value = self
            for part in name.split("."):
                value = getattr(value, part)
            if not low <= value <= high:
                wrong.append(f"{name}={value} is not in [{low}, {high}]")
        if self.chains.debris_ratio >= self.chains.dominant_ratio:
            wrong.append("chains.debris_ratio must be under chains.dominant_ratio")
        if self.gates.min_intron > self.gates.max_intron:
            wrong.append("gates.min_intron is over gates.max_intron")
        if self.molecules.normalise not in ("none", "strip_segment", "strip_ccs", "zmw"):
            wrong.append(f"molecules.normalise={self.molecules.normalise!r} is unknown")
        if self.molecules.hamming not in (0, 1):
            wrong.append("molecules.hamming is 0 or 1")
        if wrong:
            raise ValueError("; ".join(wrong))
        return self


def from_dict(values: dict[str, Any], kind: type = Config) -> Any:
    hints, known = get_type_hints(kind), {f.name for f in dataclasses.fields(kind)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown settings for {kind.__name__}: {', '.join(sorted(unknown))}")
    out = {}
    for name, value in values.items():
        if dataclasses.is_dataclass(hints[name]):
            value = from_dict(value, hints[name])
        elif isinstance(value, list):
            value = tuple(value)
        out[name] = value
    return kind(**out)


def load(path: str) -> Config:
    with open(path) as f:
        return from_dict(json.load(f)).check()


def dump(config: Config) -> str:
    return json.dumps(dataclasses.asdict(config), indent=2)


def override(config: Config, dotted: str, text: str) -> Config:
    """config with one setting replaced, such as chains.min_reads=3, read as its type."""
    head, _, rest = dotted.partition(".")
    if head not in {f.name for f in dataclasses.fields(config)}:
        raise ValueError(f"unknown setting {dotted}")
    old = getattr(config, head)
    if rest:
        return dataclasses.replace(config, **{head: override(old, rest, text)})
    if dataclasses.is_dataclass(old):
        raise ValueError(f"{dotted} is a group of settings")
    if isinstance(old, bool):
        if text.lower() not in ("true", "false", "1", "0", "yes", "no"):
            raise ValueError(f"{dotted} takes true or false")
        new: Any = text.lower() in ("true", "1", "yes")
    elif isinstance(old, int):
        new = int(text)
    elif isinstance(old, float):
        new = float(text)
    elif isinstance(old, tuple):
        new = tuple(x for x in text.split(",") if x)
    else:
        new = None if text.lower() == "none" else text
    return dataclasses.replace(config, **{head: new})
