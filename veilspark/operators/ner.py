"""Plugging a named-entity model into the scrub pipeline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ENTITY_FLAGS
from .detect import SPANS

_ARROW = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("f", pa.list_(pa.string())), ("p", pa.string()), ("o", pa.int32())]))


def model_spans(load: Callable[[], Callable[[list[str]], list[list[tuple[int, int, str]]]]]) -> Callable[[Column], Column]:
    """For scrub(..., more=model_spans(load)): spans of a model over the cleaned text.

    `load` makes the model, once per task, as a function from texts to lists of (start, end, entity type) in code points.
    Types that constants.ENTITY_FLAGS doesn't know and spans whose text contains REDACTED are left out. Null texts have
    no spans. A model's spans come before those of the rules among equals.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for batch in batches:
            texts = batch.to_pylist()
            found = iter(model([t for t in texts if t]))
            rows = []
            for t in texts:
                spans = []
                for s, e, kind in next(found) if t else []:
                    if kind in ENTITY_FLAGS and "REDACTED" not in t[s:e] and s < e:
                        flag, placeholder = ENTITY_FLAGS[kind]
                        spans.append({"s": s, "e": e, "f": [flag], "p": placeholder, "o": -1})
                rows.append(spans)
            yield pa.array(rows, _ARROW)

    udf = F.arrow_udf(run, SPANS).asNondeterministic()
    return lambda text: udf(text)
