"""Operator 4, token counts by offset-mapped attribution.

Each document is encoded once, as a whole.  The tokens' byte lengths give every token's span in the
text; spans are joined with the sections' intervals by two binary searches, both sides being sorted.
A token that crosses a boundary goes to the section that holds most of its bytes, ties to the earlier.

Sections are the stretches up to and including a run of line feeds; the pattern is a parameter.  The
vocabulary is a file of ranks whose path is a parameter; it must be readable where tasks run.

Edge cases: null and empty texts have no tokens and no sections; a text of line feeds only is one
section; repeated rows count alike; an empty table gives an empty result.  A very long text is
encoded whole, in one task.  Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagseries.llm.common import add_columns

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_encoder(path: str, pattern: str):
    """The encoder and the byte length of every token id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        length[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), length


def attribute(lengths: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Tokens per section, and how many tokens crossed a boundary.

    ``bounds``: offsets inside (0, size) where a new section begins, ascending.
    """
    n = len(bounds) + (size > 0)
    if not len(lengths):
        return np.zeros(n, np.int64), 0
    end = np.cumsum(lengths)
    start = end - lengths
    first, last = np.searchsorted(bounds, start, "right"), np.searchsorted(bounds, end - 1, "right")
    crossing = np.flatnonzero(first != last)
    home = first.copy()
    for i in crossing:
        cuts = np.concatenate(([start[i]], bounds[first[i]:last[i]], [end[i]]))
        home[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return np.bincount(home, minlength=n), len(crossing)


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections: str = r"\n+",
                   ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """One row per document: id, n_tokens, n_sections, n_crossing, section_tokens (array), and the
    digest of its comma-joined counts."""
    cut = re.compile(sections.encode())

    def start():
        enc, length = load_encoder(ranks, pattern)

        def f(texts):
            out = [[], [], [], [], []]
            for t in texts:
                ids = enc.encode_to_numpy(t.decode("utf-8"), disallowed_special=()).astype(np.int64)
                bounds = np.array([e for m in cut.finditer(t) if 0 < (e := m.end()) < len(t)], np.int64)
                counts, crossing = attribute(length[ids], bounds, len(t))
                digest = hashlib.sha256(",".join(map(str, counts.tolist())).encode()).hexdigest()
                for c, v in zip(out, (len(ids), len(counts), crossing, counts, digest), strict=True):
                    c.append(v)
            return out

        return f

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = add_columns(src, "text", start, "n_tokens bigint, n_sections bigint, n_crossing bigint, "
                      "section_tokens array<bigint>, sections_sha256 string")
    return out.drop("text").withColumnRenamed("id", id_col)
