"""Personal data by weak supervision.

Base spans (emails, IPs, cards, phones) come from fixed patterns with checks
and always stay.  Opaque strings, number groups and bare phone numbers outside
them are candidates.  Three labelers vote on every candidate or abstain: a
pattern labeler (shape and check digits), a gazetteer (families of keys, issuer
and numbering ranges, reserved and placeholder values) and a context labeler
reading the words before it.  Expectation-maximisation over the candidates' vote
patterns, with a fixed class prior (``PRIOR``), estimates each labeler's
reliability per class.  The posteriors train a logistic span classifier on what
the labelers do not say: characters, lengths and the word before the span.  A
candidate is added if at least one labeler votes for it and the mean log-odds of
its posterior and of the classifier are above 0.  Base spans teach nothing, so
their number never moves the answer for a candidate.  Votes and features are
counted as patterns of bounded number, so only counts reach the driver.

Patterns run in linear time on any text (possessive repeats, no re-reading
of long runs) and only on texts holding '@' or a digit.

Defined cases: a null text counts as empty and has no spans; base kinds may
overlap each other; an added span never overlaps a base span; a corpus
without candidates adds nothing.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "number", "tel")
KINDS = BASE + ADDED
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}")
_TEL = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_HEX = re.compile(r"[0-9a-f]++|[0-9A-F]++")
_HOLDS = re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|key|auth|bearer|"
                    r"iban|account|card|ssn|tel|phone|call|fax|mobile)\b\W*$")
_DENIES = re.compile(r"(?i)\b(?:isbn|issn|version|commit|revision|order|invoice|page|http|https|www)\b\W*$")
# Families of keys and tokens, by their fixed beginnings.
_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "sk_test_", "pk_live_",
             "rk_live_", "xoxa-", "xoxb-", "xoxp-", "xoxs-", "eyJ", "SG.", "npm_", "pypi-", "hf_", "ya29.", "shpat_")
_PLACEHOLDERS = re.compile(r"(?i)x{6,}|example|placeholder|your[_-]|changeme|12345678|abcdefgh")
# Issuer ranges of payment cards: beginning and numbers of digits.
_ISSUERS = re.compile(r"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}"
                      r"|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2}|4[4-9][0-9])[0-9]{12}|35(?:2[89]|[3-8][0-9])[0-9]{12}")
# North American numbering: area and exchange begin with 2 to 9; 555-01xx is reserved for fiction.
_NUMBERING = re.compile(r"[2-9][0-9]{2}[2-9][0-9]{6}")
_FICTION = re.compile(r"[0-9]{3}55501[0-9]{2}")
PRIOR, PRIOR_COUNT, RIGHT, WORDS = 0.2, 20.0, 0.75, 64     # share of personal data before any candidate is seen; its weight; a labeler's reliability; word buckets
_CONTEXT = 24


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(s: str):
    free, seen = 0, -1                     # end of the last match, last '@'
    at = s.find("@")
    while at >= 0:
        before = s[max(free, seen + 1):at]
        local = len(before) - len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(s, at + 1) if local else None
        if m:
            free = m.end()
            yield at - local, free
        seen = at
        at = s.find("@", max(at + 1, free))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(s: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end), by start and kind."""
    out = []
    if "@" in s:
        out += [(a, 0, b) for a, b in _emails(s)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(s) if all(map(_small, m.groups()))]
    for m in _CARD.finditer(s):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in s:
        for m in _PHONE.finditer(s):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def extra_candidates(s: str, base) -> list[tuple[int, int, str]]:
    """Opaque strings, number groups and bare phone numbers outside the base spans."""
    out = []
    for kind, pattern in ((4, _OPAQUE), (5, _CARD), (6, _TEL)):
        for m in pattern.finditer(s):
            text = m.group()
            n_digits = sum(c.isdigit() for c in text)
            if kind == 4 and not (0 < n_digits < len(text)) or kind == 5 and not 9 <= n_digits <= 19:
                continue
            out.append((m.start(), kind, m.end()))
    kept, busy = [], sorted((a, b) for a, _, b in base)
    for a, kind, b in sorted(out):
        if all(b <= x or a >= y for x, y in busy) and not (kept and a < kept[-1][2]):
            kept.append((a, kind, b))
    return kept


def signals(s: str, span) -> tuple[int, ...]:
    """(kind, pattern vote, gazetteer vote, context vote, length, digits, changes, word bucket) of a candidate.
    Votes are 1, 0 or -1 (abstains); the rest are the classifier's features."""
    a, kind, b = span
    text, before = s[a:b], s[max(0, a - _CONTEXT):a]
    digits = "".join(c for c in text if c.isdigit())
    lower, upper = any(map(str.islower, text)), any(map(str.isupper, text))
    if kind == 4:                                     # opaque: mixed case or one case of hexadecimal digits
        pattern = 1 if _HEX.fullmatch(text) or (lower and upper) else 0
        gazetteer = 1 if text.startswith(_PREFIXES) else 0 if len(set(text)) <= 4 or _PLACEHOLDERS.search(text) else -1
    elif kind == 5:                                   # a number group: check digit; issuers
        pattern = (1 if _luhn(digits) else 0) if len(digits) >= 12 else -1
        gazetteer = 0 if len(set(digits)) <= 2 else 1 if _ISSUERS.fullmatch(digits) and _luhn(digits) else -1
    else:                                             # a bare phone number: written as one; numbering plan
        pattern = 1 if len(set(text) & set(" .-()")) else -1
        gazetteer = 0 if _FICTION.fullmatch(digits) or not _NUMBERING.fullmatch(digits) else 1
    context = 1 if _HOLDS.search(before) else 0 if _DENIES.search(before) else -1
    changes = sum(x.isdigit() != y.isdigit() for x, y in zip(text, text[1:]))
    word = re.search(r"([^\W\d_]+)\W*\Z", before)
    bucket = zlib.crc32(word[1].lower().encode()) % WORDS if word else WORDS
    return kind, pattern, gazetteer, context, min(5, (b - a) // 8), 4 * len(digits) // max(1, b - a), min(4, changes // 2), bucket


def _rich(texts: pa.Array) -> np.ndarray:
    """Rows holding '@' or a digit."""
    return pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False).to_numpy(zero_copy_only=False)


def _count_signals(batches):
    for batch in batches:
        texts = W.text_column(batch, "text")
        seen: Counter = Counter()
        for i in np.flatnonzero(_rich(texts)):
            s = texts[i].as_py()
            base = base_spans(s)
            seen.update(signals(s, x) for x in extra_candidates(s, base))
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())],
                ["signal", "n"])


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 200):
    """EM over vote patterns: (posterior of class 1 per pattern, P(vote | class, it votes) by class and labeler,
    class shares).  A labeler that abstains says nothing."""
    post = np.where((votes == 1).sum(1) > (votes == 0).sum(1), 0.8, 0.2)
    # a labeler is right more often than not: pseudo-votes, half as many as it casts, so all sizes are alike
    cast = [8 + 0.5 * n[votes[:, j] >= 0].sum() for j in range(votes.shape[1])]
    agree = np.array([[RIGHT, 1 - RIGHT], [1 - RIGHT, RIGHT]])
    for _ in range(rounds):
        w = np.stack([n * (1 - post), n * post])                       # class, pattern
        share = (w.sum(1) + PRIOR_COUNT * np.array([1 - PRIOR, PRIOR])) / (w.sum() + PRIOR_COUNT)
        rates = np.stack([[[(w[c] * (votes[:, j] == v)).sum() + cast[j] * agree[c, v] for v in (0, 1)]
                           for j in range(votes.shape[1])] for c in (0, 1)])
        rates = rates / rates.sum(2, keepdims=True)
        like = np.log(share)[:, None] + sum(
            np.where(votes[:, j] >= 0, np.log(rates[:, j, np.maximum(votes[:, j], 0)]), 0.0) for j in range(votes.shape[1]))
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
        done = np.abs(new - post).max() < 1e-10
        post = new
        if done:
            break
    return post, rates, share


def _features(signal) -> list[float]:
    kind, _, _, _, length, digits, changes, word = signal
    one = lambda v, of: [float(v == x) for x in of]
    return [1.0, *one(kind, range(len(BASE), len(KINDS))), *one(length, range(6)), *one(digits, range(5)), *one(changes, range(5)),
            *one(word, range(WORDS + 1))]


class Judge(NamedTuple):
    """What was learnt: weights of the classifier, P(vote | class) by labeler and the class shares."""

    weights: np.ndarray
    rates: np.ndarray
    share: np.ndarray

    def accepts(self, signal) -> bool:
        votes = signal[1:4]
        if 1 not in votes:
            return False
        odds = math.log(self.share[1] / self.share[0]) + sum(
            math.log(self.rates[1, j, v] / self.rates[0, j, v]) for j, v in enumerate(votes) if v >= 0)
        return odds + math.fsum(a * b for a, b in zip(self.weights, _features(signal))) > 0


def fit(documents: DataFrame, text: str = "text") -> Judge | None:
    """Reliabilities and classifier from the vote patterns of all documents; None without candidates."""
    rows = (documents.select(F.col(text).alias("text")).mapInArrow(_count_signals, "signal array<int>, n long")
            .groupBy("signal").agg(F.sum("n").alias("n")).collect())
    if not rows:
        return None
    rows = sorted((tuple(r.signal), r.n) for r in rows)
    votes, n = np.array([r[0][1:4] for r in rows]), np.array([r[1] for r in rows], float)
    post, rates, share = reliabilities(votes, n)
    x = np.array([_features(r[0]) for r in rows])
    w, n = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (post - p)) - 1e-3 * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w += np.linalg.solve(hess, grad)
    return Judge(w, rates, share)


_RESULT = "base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>"


def _finder(judge: Judge | None):
    one = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    accepted: dict = {}

    def accepts(signal) -> bool:
        if signal not in accepted:
            accepted[signal] = judge is not None and judge.accepts(signal)
        return accepted[signal]

    def run(column: pa.Array) -> pa.Array:
        base = [[]] * len(column)
        spans = [[]] * len(column)
        as_rows = lambda x: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x]
        for i in np.flatnonzero(_rich(column)):
            s = column[i].as_py()
            found = base_spans(s)
            base[i] = as_rows(found)
            extra = [x for x in extra_candidates(s, found) if accepts(signals(s, x))]
            spans[i] = as_rows(sorted(found + extra))
        return pa.StructArray.from_arrays([pa.array(base, one), pa.array(spans, one)], ["base", "spans"])

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _RESULT)


def find_pii(documents: DataFrame, judge: Judge | None, text: str = "text", into: str = "pii") -> DataFrame:
    """``documents`` with a struct column ``into``: base spans and all spans (kind, start, end in code points)."""
    return documents.withColumn(into, _finder(judge)(F.col(text)))


def as_text(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op4_pii(spark, sf_dir) -> DataFrame:
    """Personal data of every document."""
    from quarry.llm.io import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, fit(docs))
    base = F.col("pii")["base"]
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias("n_" + k) for k in BASE],
                        F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("pii")["spans"]).alias("spans"))
