"""Token counts of the sections of a text.

A text is encoded once, as a whole. A byte-level BPE loses nothing, so the lengths of the
tokens' byte strings, added up, are the tokens' spans in the text; these meet the sections'
spans in an interval join within the row. A token across a boundary goes to the section
that holds most of its bytes, to the earlier one if they hold as many (``majority``), or to
the section of its first byte (``first``).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagetables.llm.common import by_text, in_arrow

RULES = ("majority", "first")


class ByteTokens:
    """Token spans by a byte-level BPE given as ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks,
                                          special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """End of each token, in bytes of the text."""
        return np.cumsum(self.lengths[np.asarray(self.encoding.encode_ordinary(text), np.int64)])


_TOKENS: dict[str, ByteTokens] = {}


def allocate(token_ends: np.ndarray, starts: np.ndarray, end: int, rule: str
             ) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of these cross a boundary. Sections begin at
    ``starts``, each ends where the next one begins, the last at ``end``."""
    counts, crossing = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    begins = np.concatenate(([0], token_ends))[:-1]
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, token_ends - 1, side="right") - 1
    home = first.copy()
    across = np.flatnonzero(first != last)
    bounds = np.append(starts, end)
    if rule == "majority":
        for t in across.tolist():
            s = np.arange(first[t], last[t] + 1)
            held = np.minimum(bounds[s + 1], token_ends[t]) - np.maximum(bounds[s], begins[t])
            home[t] = s[np.argmax(held)]
    np.add.at(counts, home, 1)
    np.add.at(crossing, home[across], 1)
    return counts, crossing


def section_tokens(docs: DataFrame, path: str, pattern: str, separator: str = "\n",
                   rule: str = "majority") -> DataFrame:
    """``(doc_id, section, char_start, char_end, n_tokens, n_crossing)`` for each section.

    A section runs to the end of ``separator``, which belongs to it; the last one to the
    end of the text. Every token of a text is counted in exactly one section. A null or
    empty text has one empty section without tokens. Rows are counted each by itself,
    repeated ones and those with a null doc_id too. An empty table gives no rows. Other
    columns are not read; texts are encoded whole, however long.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if not separator:
        raise ValueError("separator must not be empty")
    kind = docs.schema["doc_id"].dataType.simpleString()
    mark = separator.encode()
    names = ["section", "char_start", "char_end", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENS:
            _TOKENS[path] = ByteTokens(path, pattern)
        tokens = _TOKENS[path]
        for batch, texts in by_text(batches):
            rows, out = [], [[] for _ in names]
            for i, raw in enumerate(texts):
                raw = raw or b""
                parts = raw.split(mark)
                sizes = np.array([len(p) + len(mark) for p in parts], np.int64)
                starts = np.cumsum(sizes) - sizes
                counts, crossing = allocate(tokens.ends(raw.decode("utf-8")), starts, len(raw), rule)
                chars = np.concatenate(([0], np.cumsum(
                    (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
                at = chars[np.append(starts, len(raw))]
                rows.append(np.full(len(parts), i))
                for column, values in zip(out, (np.arange(len(parts)), at[:-1], at[1:],
                                                counts, crossing)):
                    column.append(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(np.concatenate(rows))),
                 *(pa.array(np.concatenate(c).astype(np.int64)) for c in out)], ["doc_id", *names])

    return in_arrow(docs.select("doc_id", "text"), run,
                    f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names))
