"""Quality rules by repetition coverage.

A text is measured by the characters of its words that lie inside duplicated runs of several numbers of
words, and inside lines that stood earlier. Runs are named by rolling hashes over the hashes of words. Each
text is measured in its own task, in numpy; nothing is shuffled.

A run of more words is duplicated only where the runs of fewer words at its begin and one word later are, so all
runs are sorted once, and of the longer ones only those whose parts were found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthframe.llm.common import BATCH_ROWS, fresh, table
from hearthframe.llm.decontam import rolling_at, word_hashes

#: Words of the windows of the base rule, words that a text must have, and percent of them that may be in repeated windows.
WINDOW, FEWEST, REPEATED = 5, 10, 20
#: Percent of the characters of words that may be inside duplicated runs of so many words (at least WINDOW).
COVERED = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Fixed value: percent of the characters of words that may be in copies of earlier lines.
LINE_CHARS = 20
SYMBOLS = b"#*$%&|<>"
_WHITE = bytes(32 if 9 <= k <= 13 else k for k in range(256))
_MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"dup_chars_{n}" for n in COVERED)]


def repeated_runs(words: np.ndarray, lengths: list[int]) -> Iterator[np.ndarray]:
    """For each of these numbers of words, ascending, which words lie inside a run of so many that is there twice or more."""
    at, least = np.arange(max(0, len(words) - lengths[0] + 1)), lengths[0]
    for n in lengths:
        if n > least and len(at):
            found = np.zeros(len(words) + 1, bool)
            found[at] = True
            for _ in range(least, n):  # both parts of a run are duplicated if it is
                at = at[found[at + 1]]
                found[:] = False
                found[at] = True
            at = at[at <= len(words) - n]
        least = n
        if len(at):
            names = rolling_at(words, at, n)
            order = np.argsort(names, kind="stable")
            same = names[order][1:] == names[order][:-1]
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            at = at[twice]
        edge = np.zeros(len(words) + 1, np.int32)
        edge[at] += 1
        np.add.at(edge, at + n, -1)
        yield np.cumsum(edge)[:-1] > 0


def measures(text: bytes | None) -> list[int]:
    """The numbers of _MEASURES for one text."""
    raw = (text or b"").translate(_WHITE)
    data = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(data == 32, prepend=True, append=True))
    upto = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = upto[edge[1::2]] - upto[edge[::2]]
    seen, n_lines, n_dup, dup_chars = set(), 0, 0, 0
    for line in (text or b"").split(b"\n"):
        if line.strip():
            n_lines += 1
            if line in seen:
                n_dup += 1
                dup_chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
            seen.add(line)
    words = word_hashes(raw)
    if len(words) != len(chars):  # a word longer than what word_hashes takes at once is several there
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, raw.split()), np.uint64, len(chars))
    lengths = sorted({WINDOW, *COVERED})
    by = dict(zip(lengths, repeated_runs(words, lengths), strict=True))
    return [len(chars), int(chars.sum()), len(raw) - len(raw.translate(None, SYMBOLS)), n_lines, n_dup, dup_chars, int(by[WINDOW].sum()), *(int(chars[by[n]].sum()) for n in COVERED)]


def measured(docs: DataFrame, name: str) -> DataFrame:
    """docs with a struct of _MEASURES, of each whole text, as one more column of this name."""
    text = F.col("text").cast("binary")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for lo in range(0, len(texts), BATCH_ROWS):
                rows = [measures(x.as_py()) for x in texts.slice(lo, BATCH_ROWS)]
                parts.append(pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], _MEASURES))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(m, pa.int64()) for m in _MEASURES]))

    # not deterministic for the planner, or each use of a measure would measure again
    return docs.withColumn(name, F.arrow_udf(run, ", ".join(f"{m} long" for m in _MEASURES)).asNondeterministic()(text))


def judged(docs: DataFrame, name: str = "quality") -> DataFrame:
    """docs with one more column, a struct: the measures, base_failed and kept.

    base_failed: fewer than FEWEST words, or more than REPEATED percent of them in windows of WINDOW words that are
    there twice or more. kept: not so, and duplicated runs cover no more characters than COVERED says, copies of
    earlier lines no more than LINE_CHARS. A null or empty text has no words and fails; texts of any length
    are measured whole; repeated rows and null doc_ids are judged alike; an empty table gives an empty one; other
    columns stay, whatever their names (the struct's name must be free).
    """
    own = fresh("_measures", docs.columns)
    m = {k: F.col(f"{own}.{k}") for k in _MEASURES}
    failed = (m["n_words"] < FEWEST) | (100 * m["n_repeat_words"] > REPEATED * m["n_words"])
    kept = ~failed & (100 * m["dup_line_chars"] <= LINE_CHARS * m["word_chars"])
    for n, most in COVERED.items():
        kept = kept & (100 * m[f"dup_chars_{n}"] <= most * m["word_chars"])
    out = F.struct(*(c.alias(k) for k, c in m.items()), failed.alias("base_failed"), kept.alias("kept"))
    return measured(docs, own).select(*docs.columns, out.alias(name))


def good(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text judged() keeps."""
    own = fresh("_quality", docs.columns)
    return judged(docs, own).where(F.col(f"{own}.kept")).drop(own)


def op13(spark, sf_dir: str) -> DataFrame:
    """doc_id, the measures, base_failed and kept, one row for each row of documents; nulls, ties and long texts as in judged()."""
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality.*")


_WORD_SQL = r"[^\x20\x09-\x0D]+"


def _covered_sql(n: int) -> str:
    """Per document the words and characters inside runs of n words that are there twice or more."""
    run = ", ".join(["w", *(f"lead(w, {j}) OVER o" for j in range(1, n))])
    return f"""
run{n} AS (SELECT doc_id, k, n_words, concat_ws(' ', {run}) AS run FROM flat WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
dup{n} AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, run) AS c FROM run{n} WHERE k + {n - 1} <= n_words) WHERE c > 1),
in{n} AS (SELECT doc_id, count(*) AS words, sum(chars) AS chars FROM flat SEMI JOIN (SELECT DISTINCT doc_id, unnest(range(k, k + {n})) AS k FROM dup{n}) USING (doc_id, k) GROUP BY doc_id),"""


OP13_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD_SQL}') AS ws FROM documents),
flat AS MATERIALIZED (SELECT doc_id, n_words, k, w, length(w) AS chars FROM (SELECT doc_id, len(ws) AS n_words, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM w)),
{"".join(map(_covered_sql, COVERED))}
split AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM w),
lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS later, list_sum(list_transform(regexp_extract_all(line, '{_WORD_SQL}'), lambda x: length(x))) AS chars FROM split WHERE regexp_matches(line, '{_WORD_SQL}')),
by_line AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (later) AS n_dup_lines, coalesce(sum(chars) FILTER (later), 0) AS dup_line_chars FROM lines GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS.decode()}]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars, CAST(coalesce(in{WINDOW}.words, 0) AS BIGINT) AS n_repeat_words, {", ".join(f"CAST(coalesce(in{n}.chars, 0) AS BIGINT) AS dup_chars_{n}" for n in COVERED)}
  FROM w LEFT JOIN by_line USING (doc_id) {" ".join(f"LEFT JOIN in{n} ON in{n}.doc_id = w.doc_id" for n in COVERED)}),
judged AS (SELECT *, n_words < {FEWEST} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {LINE_CHARS} * word_chars AND {" AND ".join(f"100 * dup_chars_{n} <= {most} * word_chars" for n, most in COVERED.items())} AS kept FROM judged
"""
