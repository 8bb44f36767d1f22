"""Options of a quantification run."""

from __future__ import annotations

from dataclasses import dataclass

STRANDS = ("unstranded", "forward", "reverse")


@dataclass(frozen=True)
class QuantConfig:
    """cb_tag, umi_tag: names of the tags; umi_tag is not read if no_umi. min_bp_overlap and min_fraction_overlap act on each pair of
    an alignment and an annotated interval; None or 0 turns them off. bin_width: of the overlap join. keep_mappings, dump_ec: write
    those files. split_tag_on_colon: a tag's value ends at its first colon. integers: accepted, without effect."""

    cb_tag: str = "CB"
    umi_tag: str = "UR"
    no_umi: bool = False
    locus: bool = False
    min_bp_overlap: int | None = None
    min_fraction_overlap: float | None = None
    strandedness: str = "unstranded"
    max_iters: int = 100
    tolerance: float = 1e-4
    dump_ec: bool = False
    keep_mappings: bool = False
    tags_check: bool = True
    split_tag_on_colon: bool = True
    bin_width: int = 16384
    integers: bool = False

    def __post_init__(self) -> None:
        if self.strandedness not in STRANDS:
            raise ValueError(f"strandedness must be one of {', '.join(STRANDS)}")
        if self.max_iters < 1:
            raise ValueError("max_iters must be at least 1")
        if self.min_fraction_overlap is not None and not 0 <= self.min_fraction_overlap <= 1:
            raise ValueError("min_fraction_overlap must lie between 0 and 1")
        if self.min_bp_overlap is not None and self.min_bp_overlap < 0:
            raise ValueError("min_bp_overlap must not be negative")
        if self.bin_width < 1:
            raise ValueError("bin_width must be positive")
