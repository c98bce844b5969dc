"""The one text step without a Spark built-in: HTML entities and Unicode compatibility forms."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = re.compile(r"<[^>]+>")
#: Texts taken at a time, however many a batch has.
SLICE = 64
#: Characters outside ASCII that NFKC leaves as they are, whatever stands beside them: no marks, no compatibility forms.
_STABLE = (
    r"\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E"  # Latin
    r"\u0386\u0388\u0389\u038A\u038C\u038E-\u03A1\u03A3-\u03CF\u0400-\u0482\u048A-\u052F\u05D0-\u05EA\u0620-\u064A"  # Greek, Cyrillic, Hebrew, Arabic
    r"\u2012-\u2016\u2018-\u2023\u20AC\u3001-\u3003\u3008-\u3011\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3"  # punctuation, East Asia
)
#: What a text must hold for the cleaning to change it; ASCII is passed over first, as it is most of a text.
MAY_CHANGE = rf"[&<]|(?![\x00-\x7F])[^{_STABLE}]"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def clean(text: str) -> str:
    """Entities are decoded first, so that encoded tags go too; then tags, then compatibility forms."""
    return unicodedata.normalize("NFKC", TAG.sub(" ", html.unescape(text)))


def cleaned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for start in range(0, len(batch), SLICE):
            yield pa.array([None if t is None else clean(t) for t in batch.slice(start, SLICE).to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _cleaned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from cleaned(batches)


def can_change(text: Column) -> Column:
    return F.when(is_ascii(text), F.contains(text, F.lit("&")) | F.contains(text, F.lit("<"))).otherwise(F.rlike(text, F.lit(MAY_CHANGE)))


def unescape_nfkc(text: Column) -> Column:
    """Only texts that can change go to Python; words with accents or in other scripts stay as they are."""
    return F.coalesce(_cleaned(F.when(can_change(text), text)), text)
