"""Line-first quality rules: remove failing lines, then reject documents that lose much."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.common import as_bytes, map_batches

MIN_WORDS = 50
MAX_REPEATED = 50  # hundredths of the words
WINDOW = 3
# Share of its words that a document may lose with the lines removed.
MAX_LOST = 0.3
# Share of a line's bytes that must be letters, digits or beyond ASCII, for lines of fewer
# words than SHORT_LINE and for others: one mark weighs much in a short line.
MIN_TEXT_SHORT, MIN_TEXT = 0.5, 0.8
SHORT_LINE = 5
NAVIGATION_PARTS = 3
NAVIGATION_WORDS = 3

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
PLAIN = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
BOILERPLATE = re.compile(
    rb"all rights reserved|cookie (?:policy|settings|preferences)|(?:uses|accept(?: all)?) cookies"
    rb"|terms (?:of (?:use|service)|and conditions)|privacy policy|enable javascript|javascript is (?:disabled|required)"
    rb"|subscribe to our newsletter|sign up for our|click here to|skip to (?:main )?content|follow us on"
    rb"|share (?:this|on) (?:facebook|twitter)|powered by wordpress|lorem ipsum",
    re.IGNORECASE,
)
SEPARATOR = re.compile(r"\||»|›|•|·| [/>-] ".encode())

_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
        ("kept", pa.bool_()), ("n_lines_removed", pa.int64()), ("lost", pa.float64()), ("clean", pa.string()),
    ]
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more in the list, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    code, base = ids[:n], len(numbers)
    for k in range(1, window):
        if base * len(numbers) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            base = n
        code = code * len(numbers) + ids[k : n + k]
        base *= len(numbers)
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : n + k] |= twice
    return int(covered.sum())


def line_fails(line: bytes, max_words: int = 30) -> bool:
    """Whether a line is punctuation, navigation or boilerplate.

    Punctuation: more than a fifth of its bytes besides white space are ASCII marks, or
    more than half in a line of fewer than five words. Navigation: three or more parts between separators, of three words or
    fewer on the average, in a line of no more than ``max_words``. Boilerplate: a fixed
    phrase in such a line, or phrases that make up half of the words or more in a longer one,
    which may be a whole paragraph or document. A line without words does not fail.
    """
    solid = line.translate(None, SPACE)
    if not solid:
        return False
    least = MIN_TEXT if len(line.split()) >= SHORT_LINE else MIN_TEXT_SHORT
    if len(solid.translate(None, PLAIN)) > (1 - least) * len(solid):
        return True
    parts = [p for p in SEPARATOR.split(line) if p.strip()]
    if len(parts) >= NAVIGATION_PARTS:
        words = sum(len(p.split()) for p in parts)
        if words <= max_words and words <= NAVIGATION_WORDS * len(parts):
            return True
    phrases = BOILERPLATE.findall(line)
    if not phrases:
        return False
    n = len(line.split())
    return n <= max_words or 2 * sum(len(p.split()) for p in phrases) >= n


def judge(text: bytes | None, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED, max_lost: float = MAX_LOST) -> tuple:
    """All columns of ``assess`` but the id, for one text."""
    text = text or b""
    words = text.split()
    lines = text.split(b"\n")
    with_words = [line for line in lines if line.strip()]
    repeated = repeated_words(words)
    failed = len(words) < min_words or 100 * repeated > max_repeated * len(words)
    good = [line for line in lines if not line_fails(line)]
    left = sum(len(line.split()) for line in good) if len(good) < len(lines) else len(words)
    lost = 1 - left / len(words) if words else 0.0
    return (
        len(words),
        len(text.translate(None, SPACE + CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(with_words) - len(set(with_words)),
        repeated,
        failed,
        not failed and left >= min_words and lost <= max_lost,
        len(lines) - len(good),
        lost,
        b"\n".join(good),
    )


def _assess(keep_text: bool):
    def assess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in as_bytes(batch["text"]):
                *head, clean = judge(text)
                rows.append((*head, clean.decode() if keep_text else None))
            columns = list(zip(*rows)) if rows else [()] * (len(_OUT) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[pa.array(c, f.type) for c, f in zip(columns, list(_OUT)[1:])]], schema=_OUT
            )

    return assess


def assess(docs: DataFrame, id: str = "doc_id", text: str = "text", clean: bool = True) -> DataFrame:
    """Counts, verdict and cleaned text of every row, without shuffle.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` describe the whole text;
    ``base_failed``: fewer than 50 words, or more than half of them repeated. Then each line
    is judged by itself (``line_fails``); the failing ones are removed, and the document is
    kept unless it is left with fewer than 50 words or lost more than 0.3 of them. ``clean``
    is the text left, null if not asked for. A null text counts as empty and is rejected; a
    null id stays null; repeated rows are judged alike; an empty table gives no rows. Other
    columns are not read.
    """
    rows = docs.selectExpr(f"cast(`{id}` as bigint) as doc_id", f"`{text}` as text")
    return map_batches(
        rows, _assess(clean),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, n_lines_removed long, lost double, clean string",
    )


def _filter_documents(text_at: int, chars_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [judge(t) for t in as_bytes(batch.column(text_at))]
            kept = [i for i, v in enumerate(verdicts) if v[6]]
            if not kept:
                continue
            part = batch.take(pa.array(kept))
            texts = [verdicts[i][9].decode() for i in kept]
            arrays = list(part.columns)
            arrays[text_at] = pa.array(texts, part.schema.field(text_at).type)
            if chars_at is not None:
                arrays[chars_at] = pa.array([len(t) for t in texts], part.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return run


def filter_documents(docs: DataFrame, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """The rows of kept documents with their cleaned text, all columns in place, without shuffle.

    ``chars`` names the column with the text's length, which follows the text. The verdict
    is that of ``assess``; null and empty texts are rejected.
    """
    at = docs.columns.index(text)
    chars_at = docs.columns.index(chars) if chars in docs.columns else None
    return map_batches(docs, _filter_documents(at, chars_at), docs.schema)
