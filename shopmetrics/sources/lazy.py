"""Datasets as mappings whose tables are built on first use."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame

Tables = Mapping[str, DataFrame]
Builder = Callable[[], DataFrame]


class LazyTables(Mapping[str, DataFrame]):
    """Tables by name; names without a builder come from ``base``.

    A transform over a dataset only plans, and only stages, what is read from
    its result.
    """

    def __init__(self, builders: Mapping[str, Builder], base: Tables | None = None):
        self._builders = dict(builders)
        self._base: Tables = {} if base is None else base
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]() if name in self._builders else self._base[name]
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(dict.fromkeys([*self._base, *self._builders]))

    def __len__(self) -> int:
        return len(set(self._base) | set(self._builders))
