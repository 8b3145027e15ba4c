"""Run configuration: checked once, on the driver, before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass

MODES = ("single", "split", "chunk", "remote")


@dataclass(frozen=True)
class PackConfig:
    """How to select, lay out and render files.

    ``mode`` picks the layout: one document per repository (``single``), one per
    directory (``split``), one per token budget (``chunk``), or one per repository
    taken from a remote listing (``remote``).
    """

    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    mode: str = "single"
    output_name: str | None = None
    toc: bool = True
    tree: bool = True
    max_tokens: int = 200_000
    max_file_kb: int = 500
    chunk_tokens: int = 150_000
    strip_comments: bool = False
    ignore_name: str | None = ".packignore"
    generator: str = "corpuspack"
    generated_at: str = ""

    def __post_init__(self) -> None:
        object.__setattr__(self, "include", tuple(self.include))
        object.__setattr__(self, "exclude", tuple(self.exclude))
        if not self.include:
            raise ValueError("at least one include pattern is required")
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}, not {self.mode!r}")
        if self.mode == "split" and self.output_name is not None:
            raise ValueError("split mode names its documents after directories; leave output_name unset")

    @property
    def prune_dirs(self) -> bool:
        """Directory-walk semantics: an excluded directory hides everything below it.

        Remote listings are flat, so nothing is pruned there.
        """
        return self.mode != "remote"

    @property
    def max_file_bytes(self) -> int:
        return self.max_file_kb * 1024
