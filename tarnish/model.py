"""Driver-side metadata: functional dependencies and how they combine into configurations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class FD:
    """`lhs -> rhs`; `redundant` columns repeat the same information and are corrupted together with it."""

    lhs: tuple[str, ...]
    rhs: str
    redundant: tuple[str, ...] = ()

    def __post_init__(self):
        if isinstance(self.lhs, str):
            raise TypeError("lhs is a tuple of column names")
        if self.rhs in self.lhs:
            raise ValueError(f"{self.rhs} is on both sides")

    @property
    def name(self) -> str:
        return f"{'+'.join(self.lhs)} -> {self.rhs}"

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.lhs, self.rhs)


def ordered_union(groups: Iterable[Sequence[str]]) -> list[str]:
    """Columns of all groups in order of first appearance, each once."""
    return list(dict.fromkeys(c for group in groups for c in group))


def fd_columns(fds: Sequence[FD]) -> list[str]:
    return ordered_union(fd.columns for fd in fds)


def corrupted_columns(fds: Sequence[FD], corrupt_lhs: bool = True) -> list[str]:
    """Columns a configuration corrupts: left sides, right sides and redundant columns, each once."""
    return ordered_union(((fd.lhs if corrupt_lhs else ()) + (fd.rhs,) + fd.redundant) for fd in fds)


def configurations(pool: Sequence[FD], sizes: Sequence[int] | None = None) -> dict[str, list[FD]]:
    """Cumulative configurations C1, C2, ... taking the first k dependencies of the pool."""
    return {f"C{k}": list(pool[:k]) for k in (sizes or range(1, len(pool) + 1))}


def redundancy_dependencies(fds: Sequence[FD]) -> list[FD]:
    """The dependencies that make every redundant column redundant."""
    return [FD(fd.lhs, c) for fd in fds for c in fd.redundant]
