"""Thresholds and presets of the evaluation and correction plans."""

from __future__ import annotations

from dataclasses import dataclass

#: datatype: (mapper preset, least mapping quality, least identity)
DATATYPES = {
    "clr": ("map-pb", 0, 0.80),
    "hifi": ("map-hifi", 10, 0.99),
    "nanopore_94": ("map-ont", 5, 0.85),
    "nanopore_1041": ("lr:hq", 5, 0.85),
}


@dataclass(frozen=True)
class Config:
    datatype: str = "nanopore_1041"
    read_coverage: float = 0.0  # 0: no subsampling
    min_depth: int | None = None  # None: a tenth of the depth limit
    min_mapping_quality: int = 20
    min_contig_length: int = 10_000
    min_large_contig_length: int = 1_000_000
    min_size: int = 50
    max_size: int = 4_000_000
    min_correction_support: int = 1
    default_coverage: int = 20
    min_final_support: int = 10

    def __post_init__(self):
        if self.datatype not in DATATYPES:
            raise ValueError(f"unknown datatype {self.datatype!r}; known: {', '.join(DATATYPES)}")

    @property
    def preset(self) -> str:
        return DATATYPES[self.datatype][0]

    @property
    def support_ratio(self) -> float:
        return 0.8 if self.datatype == "hifi" else 0.7

    @property
    def null_rate(self) -> float:
        """Rate of wrong bases under which a base error is tested."""
        return 0.5 if self.datatype == "hifi" else 0.4

    @property
    def read_cutoff(self) -> float:
        return 0.75 if self.datatype == "hifi" else 0.5

    def p_cutoff(self, depth):
        """The level of the test by depth, as a column."""
        from pyspark.sql import functions as F

        if self.datatype == "hifi":
            return F.when(depth < 15, 0.1).when(depth < 25, 0.02).otherwise(0.01)
        return F.when(depth < 25, 0.1).otherwise(0.05)
