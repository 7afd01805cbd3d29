"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for each rule that
failed; policies are versioned sets of bits, so a new policy or an ablation reads the ledger and never the texts.

Defined cases: a null or empty text has no words (all measurements 0) and fails few_words; a null id is kept as a row
with a null id; repeated rows give repeated rows; an empty table gives an empty ledger; further columns of the input,
whatever their names, take no part in ledger() and come through keep_documents() unchanged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, with_arrow_column

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
_KIND = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])


@dataclass(frozen=True)
class Rule:
    """fails: true where the document breaks the rule; written over the measurements."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "2 * n_symbols > n_words"),
    Rule("shouting", 3, "n_letters >= 20 and 2 * n_upper > n_letters"),
    Rule("repeated_lines", 4, "n_lines >= 8 and 2 * n_dup_lines > n_lines"),
    Rule("word_length", 5, "n_words >= 20 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
)
BITS = {r.name: 1 << r.bit for r in RULES}

#: Versions are only ever added. A policy rejects a document when one of its rules has failed.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "shouting", "repeated_lines", "word_length"),
}


def policy_mask(version: str) -> int:
    return sum(BITS[name] for name in POLICIES[version])


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more; exact, as ids of pairs, fours and eights of words."""
    n = len(words)
    if n <= WINDOW:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    if len(index) == n:
        return 0
    for step in (1, 2, 4):
        pairs = ids[:-step] * (n + 1) + ids[step:]
        distinct, ids = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0
    at = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chars = len(text) - sum(map(text.count, SPACES))
    lower, upper = text.lower(), text.upper()
    if text.isascii():
        raw = np.frombuffer(text.encode(), np.uint8)
        n_upper = int(((raw >= 65) & (raw <= 90)).sum())
        n_letters = n_upper + int(((raw >= 97) & (raw <= 122)).sum())
    elif len(lower) == len(text) == len(upper):
        a, lo, up = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (text, lower, upper))
        n_upper, n_letters = int((a != lo).sum()), int((up != lo).sum())
    else:
        n_upper, n_letters = sum(x.isupper() for x in text), sum(x.isupper() or x.islower() for x in text)
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines), n_upper, n_letters


def _measures(texts: pa.Array) -> pa.Array:
    rows = [measure(t) for t in texts.to_pylist()]
    columns = zip(*rows, strict=True) if rows else ((),) * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))


def _mask(of: str) -> Column:
    """Bit by bit, each rule once."""
    mask = F.lit(0).cast("long")
    for r in RULES:
        fails = re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"`{of}`.\1", r.fails)
        mask = mask.bitwiseOR(F.when(F.expr(fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return mask


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements, failures: one bit for each rule."""
    narrow = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    m = free_name(narrow, "measured")
    return with_arrow_column(narrow, m, _KIND, _measures, ["text"]).select(id_col, *(F.col(f"{m}.{x}").alias(x) for x in MEASURES), _mask(m).alias("failures"))


def verdict(version: str) -> Column:
    """True where the policy keeps the row of a ledger."""
    return F.col("failures").bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0


def keep_documents(docs: DataFrame, version: str = "v1", text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns only."""
    m = free_name(docs, "measured")
    return with_arrow_column(docs, m, _KIND, _measures, [text_col]).filter(_mask(m).bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def ablations(rows: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a policy: how many documents fail it, fail it alone (dropping the rule would keep them), and how many
    the policy rejects; one aggregation over the masks."""
    mask = policy_mask(version)
    failed = F.col("failures").bitwiseAND(F.lit(mask).cast("long"))
    n = lambda cond: F.count(F.when(cond, 1))
    counts = rows.agg(
        n(failed != 0).alias("rejected"), F.count(F.lit(1)).alias("documents"),
        *(n(failed.bitwiseAND(F.lit(BITS[r]).cast("long")) != 0).alias(f"fail_{r}") for r in POLICIES[version]),
        *(n(failed == BITS[r]).alias(f"alone_{r}") for r in POLICIES[version]),
    )
    return counts.select("documents", "rejected", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"fail_{r}").alias("fails"), F.col(f"alone_{r}").alias("fails_alone")) for r in POLICIES[version]))).alias("r")).select(F.lit(version).alias("policy"), "r.rule", "r.fails", "r.fails_alone", "rejected", "documents")


def query(docs: DataFrame) -> DataFrame:
    base = F.col("failures").bitwiseAND(F.lit(policy_mask("base")).cast("long")) != 0
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & verdict("v1")).alias("kept"), "failures")


SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
k as (select *, row_number() over () as k from w),
g as (select k, len(words) as n, unnest(range(1, greatest(len(words) - 7, 0) + 1)) as i, words from k where len(words) > 8),
h as (select k, n, i, array_to_string(words[i:i + 7], ' ') as win from g),
c as (select k, n, i, count(*) over (partition by k, win) as c from h),
r as (select k, count(distinct p) as n_repeat from (select k, unnest(range(i, i + 8)) as p from c where c.c > 1) group by k),
m as (select doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
             coalesce(r.n_repeat, 0) as n_repeat_words, len(lines) as n_lines,
             length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) as n_upper, length(regexp_replace(text, '[^\p{Lu}\p{Ll}]', '', 'g')) as n_letters
      from k left join r using (k)),
f as (select *, (case when n_words < 20 then 1 else 0 end) + (case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end)
             + (case when 2 * n_symbols > n_words then 4 else 0 end) + (case when n_letters >= 20 and 2 * n_upper > n_letters then 8 else 0 end)
             + (case when n_lines >= 8 and 2 * n_dup_lines > n_lines then 16 else 0 end)
             + (case when n_words >= 20 and (word_chars < 2 * n_words or word_chars > 15 * n_words) then 32 else 0 end) as failures from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
       n_repeat_words::bigint as n_repeat_words, (failures::bigint & 3) <> 0 as base_failed, failures = 0 as kept, failures::bigint as failures
from f
"""
