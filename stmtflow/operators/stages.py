"""Named pipeline stages: register ``DataFrame -> DataFrame`` functions by name and
run a sequence of them with ``DataFrame.transform``. Black-box stages (a model
client, say) are ordinary stages built on ``model_extract``'s ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

Stage = Callable[[DataFrame], DataFrame]


class StageRegistry:
    def __init__(self) -> None:
        self._stages: dict[str, Stage] = {}

    def register(self, name: str, fn: Stage | None = None):
        """``registry.register("x", fn)`` or as a decorator ``@registry.register("x")``."""
        if fn is None:
            return lambda f: self.register(name, f)
        if name in self._stages:
            raise ValueError(f"stage already registered: {name}")
        self._stages[name] = fn
        return fn

    def __contains__(self, name: str) -> bool:
        return name in self._stages

    def names(self) -> list[str]:
        return sorted(self._stages)

    def get(self, name: str) -> Stage:
        try:
            return self._stages[name]
        except KeyError:
            raise KeyError(f"unknown stage: {name}") from None

    def run(self, df: DataFrame, names: Iterable[str]) -> DataFrame:
        for name in names:
            df = df.transform(self.get(name))
        return df


def default_registry() -> StageRegistry:
    """The library's own operators as stages over ``(doc_id, text, ...)`` frames."""
    from .extract import extract_bills
    from .responses import validate_response
    from .text import context_budget, filter_blank_content, text_measure

    reg = StageRegistry()
    reg.register("filter_blank_content", filter_blank_content)
    reg.register("text_measure", text_measure)
    reg.register("context_budget", context_budget)
    reg.register("extract_bills", lambda df: extract_bills(df, keep=tuple(c for c in df.columns
                                                                          if c not in ("doc_id", "text"))))
    reg.register("validate_response", validate_response)
    return reg
