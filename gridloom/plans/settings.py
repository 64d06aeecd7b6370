"""How large blocks are, how many tasks work on them, and where results are realized."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from gridloom.plans.geometry import chunk_shape


@dataclass
class Settings:
    """block_cells: cells of a block at most. block_shape: as for chunks. workers: tasks, None as the session has it. backend: files or memory."""

    block_cells: int = 1_000_000
    block_shape: str = "scale"
    workers: int | None = None
    backend: str = "files"

    def __post_init__(self) -> None:
        if self.block_cells < 1 or self.workers is not None and self.workers < 1:
            raise ValueError("blocks have cells, and there are workers")
        self.set_backend(self.backend)

    def set_backend(self, backend: str) -> None:
        if backend not in ("files", "memory"):
            raise ValueError(f"backend {backend!r}: files or memory")
        self.backend = backend

    def block(self, dim: Sequence[int]) -> tuple[int, ...]:
        return chunk_shape(dim, self.block_cells, self.block_shape)


#: What holds where nothing else is said.
SETTINGS = Settings()
