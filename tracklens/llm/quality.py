"""Line-first cleaning: rules on every line, failing lines go, then documents that lost too much text go.

Rules of a line (a line is what ``\\n`` separates; lines without a word are neither judged nor counted):

* ``punctuation``: no sentence ends in or at the end of the line, or doubled marks (``!!``, ``??``) close many of its words;
* ``navigation``: separators or markup symbols take the place of prose, or the line is a short menu entry;
* ``boilerplate``: a short line with a legal, cookie, script or sign-up phrase;
* ``shouting``: most of its words are in capitals;
* ``stutter``: many words equal the word before;
* ``duplicate``: equal to an earlier line of the document.

Null texts count as empty.  Empty texts have zero counts, fail the base rule and are rejected.  Repeated rows are
judged one by one.  Other columns are carried through; the result's own names replace columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, map_rows

# Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Phrases of lines that are not prose.
BOILERPLATE = re.compile(
    r"all rights reserved|licensed under|released under the|\blicense\b|copyright|©|\(c\) ?\d{4}|terms of (?:use|service)|privacy policy|cookie|javascript|lorem ipsum"
    r"|sign (?:in|up)|log ?in|subscribe|newsletter|click here|read more|share (?:this|on)|powered by|skip to|back to top|alle rechte vorbehalten|tous droits réservés|todos los derechos",
    re.IGNORECASE,
)
SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*(?:\s|$)")
SEPARATORS = frozenset("| › » > < / · • – — - ~ :: >> <<".split())


@dataclass(frozen=True)
class Rules:
    boilerplate_words: int = 25  # longer lines are prose, whatever phrase they hold
    menu_words: int = 4
    inner_end_words: int = 8  # a line this long may end without a mark if a sentence ends inside
    marks_share: float = 0.3
    symbol_share: float = 0.2
    separator_share: float = 0.15
    capital_share: float = 0.6
    stutter_share: float = 0.3
    lost_share: float = 0.5  # a document goes when it loses more of its words


def judge_line(line: str, words: list[str], r: Rules) -> str | None:
    """The rule that the line fails, or None."""
    n = len(words)
    if sum(map(eq, words, words[1:])) > r.stutter_share * n:
        return "stutter"
    symbols = sum(any(c in w for c in SYMBOLS) for w in words) if any(c in line for c in SYMBOLS) else 0
    if sum(w in SEPARATORS for w in words) > r.separator_share * n or symbols > r.symbol_share * n:
        return "navigation"
    if n >= 3 and sum(map(str.isupper, words)) > r.capital_share * n:
        return "shouting"
    if ("!!" in line or "??" in line) and sum(w.endswith(("!!", "??")) for w in words) > r.marks_share * n:
        return "punctuation"
    if n <= r.boilerplate_words and BOILERPLATE.search(line):
        return "boilerplate"
    last = line.rstrip().rstrip("\"'”’»)]")[-1:]
    if last not in tuple(".!?…:;。！？"):
        if n <= r.menu_words:
            return "navigation"
        if n < r.inner_end_words or not SENTENCE_END.search(line):
            return "punctuation"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    v = len(number) + 1
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    if v < 2_000_000:
        pair, keys = None, (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:  # past 2^63: number the pairs first
        pair = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)[1]
        keys = pair * v + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(n + 1, bool)
    twice[:n][order[1:][same]] = True
    twice[:n][order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    step[at] += 1
    step[at + 3] -= 1
    return int((np.cumsum(step)[:-1] > 0).sum())


def judge(raw: bytes, r: Rules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_kept_words, failed lines by rule, text left)."""
    text = raw.decode("utf-8", "replace")
    words = raw.split()  # bytes split on exactly the six separators
    n = len(words)
    seen, duplicates, failed, left, left_words = set(), 0, {}, [], 0
    for line in text.split("\n"):
        own = line.encode().split()
        if not own:
            left.append(line)
            continue
        rule = "duplicate" if line in seen else judge_line(line, [w.decode() for w in own], r)
        duplicates += line in seen
        seen.add(line)
        if rule is None:
            left.append(line)
            left_words += len(own)
        else:
            failed[rule] = failed.get(rule, 0) + 1
    repeats = repeated_words(words)
    base = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    kept = not base and left_words >= (1 - r.lost_share) * n
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicates, repeats, base, kept, left_words, failed, "\n".join(left) if failed else text)


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_kept_words long, failed_lines map<string,int>, clean_text string"


def line_quality(docs: DataFrame, text: str = "text", carry: Iterable[str] = ("doc_id",), rules: Rules = Rules()) -> DataFrame:
    """``carry`` columns plus counts, verdict, failed lines by rule and the text without failed lines, one row for each row."""
    names = {c.split()[0] for c in OUT.split(", ") if " " in c}
    carry = [c for c in carry if c not in names]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    ddl = ", ".join([*(f"`{c}` {fields[c]}" for c in carry), OUT])

    def start():
        def one(*row):
            *own, raw = row
            *base, failed, left = judge(raw or b"", rules)
            yield (*[x.decode() if isinstance(x, bytes) and fields[c] == "string" else x for c, x in zip(carry, own)], *base, list(failed.items()), left)

        return one

    return map_rows(docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`")), ddl, start)
