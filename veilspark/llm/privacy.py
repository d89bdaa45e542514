"""Personal data by weak supervision: labelers vote on candidate spans, and no one labels a span by hand.

Candidates are the base matches, what looked like one but failed its test, and looser forms (masked
addresses, local phone numbers, identity numbers, account numbers, titled names, street addresses). Six labelers vote
for, against or not at all: the shape (formats and check digits), a gazetteer (domain endings, issuers,
country codes, given names), the words on the left, the characters on both sides, other data close by,
and fillers (digits in a row). Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is and how common true spans are in each kind; its posteriors are the targets
of the final classifier, logistic in votes and context, which judges every candidate that isn't a base span.

Two passes over the texts, with no shuffle of texts: the first counts candidates by their features (a
combined aggregate), the second judges. There are at most 3**6 vote patterns a kind, all of which EM uses with
their counts over all documents; the classifier is fitted on the distinct feature rows, by their counts, of
which about SAMPLE a kind are taken at most (by their hash).

Defined results: null and empty texts hold nothing; equal rows get equal results each; a null doc_id is
carried as it is; extra columns are ignored; an empty table gives no rows (and a model without
knowledge, which adds nothing). Offsets count code points. Base spans always stay; an added span overlaps no base
span and no other added one (the likelier stays, then the earlier kind, then the earlier start).
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textcore import buffers, trimmed

BASE = ("email", "ip", "card", "phone")
ADDED = ("number", "masked_email", "local_phone", "id_number", "account", "person", "address")
KINDS = BASE + ADDED
LABELERS = 6
#: Distinct feature rows of a kind that the classifier is fitted on, about, at most.
SAMPLE = 2000
BUCKETS = 1 << 12
ROUNDS, STEPS, RATE, RIDGE = 60, 300, 0.1, 1e-3
#: Characters on the left that are read for words, and those within which other data count as close.
LEFT, CLOSE = 40, 100
#: Digits of a failed match that is looked at once more.
FEWEST = 7

# fixed values: gazetteers and cues
ENDINGS = frozenset("com org net edu gov mil int info biz io de fr es it uk nl be ch at pl pt se no fi dk ie eu us ca au br mx ar cl in jp cn kr ru za".split())
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 353 358 420 852 971 972".split())
ACCOUNT_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT RO SE SK".split())
GIVEN_NAMES = frozenset("james mary john anna michael linda david sarah thomas laura peter maria paul julia hans klaus petra ursula jean pierre marie claire luis carmen jose ana carlos elena pablo lucia".split())
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Monsieur", "Madame", "Sr", "Sra", "Señor", "Señora")
STREETS = ("Street", "Avenue", "Road", "Lane", "Drive", "Boulevard", "Court", "Square", "Terrace")
CUES = {
    "email": "mail email contact write reply".split(), "ip": "ip host address server login from".split(), "card": "card visa mastercard amex credit debit".split(),
    "phone": "phone tel telephone call mobile cell fax contact".split(), "number": "account passport ssn licence license id insurance".split(), "masked_email": "mail email contact write reply".split(),
    "local_phone": "phone tel telephone call mobile cell fax contact".split(), "id_number": "ssn social security id".split(), "account": "iban account bank konto compte cuenta".split(),
    "person": "name dear signed from by".split(), "address": "address lives street home at ship".split(),
}
COUNTER_CUES = frozenset("version isbn issn doi order page pages chapter figure table section invoice serial sku build rev revision hash sha port line item model".split())

_MARKS = [f"{t}{end}".encode() for t in TITLES for end in (" ", ". ")]
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"[\[(] ?(?:at|AT) ?[\])]")
_MASKED = re.compile(r" ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z0-9-]{1,63}){1,5}")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")
_PERSON = re.compile(r"(?<![^\W_])(?:%s)\.? ([A-ZÀ-Þ][^\W\d_]{1,30})(?: ([A-ZÀ-Þ][^\W\d_]{1,30}))?" % "|".join(TITLES))
_ADDRESS = re.compile(r"(?<![^\W_])[0-9]{1,5} (?:[A-Z][a-z]{1,20} ){1,3}(?:%s)(?![^\W_])" % "|".join(STREETS))
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches without overlaps, each character read a bounded number of times."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        i = at
        while i > last and text[i - 1] in _LOCAL:
            i -= 1
        m = _DOMAIN.match(text, at + 1) if i < at else None
        if m:
            out.append((i, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_matches(text: str, at: bool, digit: bool) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, kept) by kind, then start; failing matches too. at, digit: whether the text holds such a character."""
    out = [("email", a, b, True) for a, b in emails(text)] if at else []
    if digit:
        small = lambda x: len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255
        out += [("ip", m.start(), m.end(), all(map(small, m[0].split(".")))) for m in _IP.finditer(text)]
        for m in _CARD.finditer(text):
            d = _digits(m[0]) if m.end() - m.start() <= 64 else ""
            out.append(("card", m.start(), m.end(), 13 <= len(d) <= 19 and luhn(d)))
        out += [("phone", m.start(), m.end(), 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15) for m in _PHONE.finditer(text)]
    return out


def loose_matches(text: str, digit: bool, title: bool) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for m in _AT.finditer(text):
        i = m.start() - (m.start() > 0 and text[m.start() - 1] == " ")
        a = i
        while a > max(0, i - 64) and text[a - 1] in _LOCAL:
            a -= 1
        if a < i and (d := _MASKED.match(text, m.end())):
            out.append(("masked_email", a, d.end()))
    if digit:
        for kind, p in (("local_phone", _LOCAL_PHONE), ("id_number", _ID), ("account", _ACCOUNT), ("address", _ADDRESS)):
            out += [(kind, m.start(), m.end()) for m in p.finditer(text)]
    if title:
        out += [("person", m.start(), m.end()) for m in _PERSON.finditer(text)]
    return out


def _shape(kind: str, s: str, kept: bool) -> int:
    d = _digits(s)
    if kind in ("email", "masked_email"):
        good = ".." not in s and s[0] != "." and re.search(r"[A-Za-z]{2,}$", s)
    elif kind in BASE:
        good = kept
    elif kind == "number":
        return -1 if len(d) < 9 else 0
    elif kind == "local_phone":
        good = d[0] not in "01"
    elif kind == "id_number":
        good = d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    elif kind == "account":
        moved = s.replace(" ", "")
        good = int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1
    else:
        return int(kind == "address" or s.count(" ") > 1)
    return 1 if good else -1


def _gazetteer(kind: str, s: str) -> int:
    d = _digits(s)
    if kind in ("email", "masked_email"):
        found = re.search(r"[A-Za-z]+$", s)
        return 1 if found and found[0].lower() in ENDINGS else -1
    if kind == "ip":
        first = s.split(".", 1)[0].lstrip("0") or "0"
        return -1 if len(first) > 3 or int(first) in (0, 127) or int(first) >= 224 else 1
    if kind == "card":
        two, four = int(d[:2] or 0), int(d[:4] or 0)
        return 1 if d[:1] == "4" or 51 <= two <= 55 or 2221 <= four <= 2720 or two in (34, 35, 36, 37, 38, 62, 65) or four == 6011 else -1
    if kind == "phone":
        return 1 if any(d[:k] in COUNTRY_CODES for k in (1, 2, 3)) else -1
    if kind == "account":
        return 1 if s[:2] in ACCOUNT_COUNTRIES else -1
    if kind == "person":
        return int(any(w.lower() in GIVEN_NAMES for w in _WORD.findall(s)))
    return int(kind == "address")


def _filler(s: str) -> int:
    d = _digits(s)
    if len(d) < 7:
        return 0
    steps = {(ord(b) - ord(a)) % 10 for a, b in zip(d, d[1:], strict=False)}
    return -1 if len(steps) == 1 else 0


@dataclass(frozen=True)
class Candidate:
    kind: int
    start: int
    end: int
    base: bool
    votes: int
    features: tuple[int, ...]


@functools.lru_cache(1 << 14)
def _hash(*parts: object) -> int:
    h = 1469598103934665603
    for c in "\x1f".join(map(str, parts)).encode():
        h = (h ^ c) * 1099511628211 & (1 << 64) - 1
    return (h ^ h >> 29) % BUCKETS


def _near(begin: list[int], ends: list[int], a: int, b: int) -> bool:
    """Whether one of the disjoint spans ends within CLOSE characters before a or begins so soon after b."""
    i, j = bisect.bisect_left(begin, b), bisect.bisect_right(ends, a) - 1
    return i < len(begin) and begin[i] <= b + CLOSE or j >= 0 and ends[j] >= a - CLOSE


def _outside(kept: list[tuple[str, int, int]]):
    """A test whether a span overlaps none of those kept."""
    begin, furthest, top = [], [], 0
    for _, a, b in sorted(kept, key=lambda x: x[1]):
        top = max(top, b)
        begin.append(a)
        furthest.append(top)

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(begin, b) - 1
        return i < 0 or furthest[i] <= a

    return free


def candidates(text: str, at: bool, digit: bool, title: bool) -> list[Candidate]:
    """All candidates by kind and start, with their votes (base 3, a digit a labeler) and hashed features."""
    matches = base_matches(text, at, digit)
    kept = [(k, a, b) for k, a, b, ok in matches if ok]
    # what failed its test is looked at once more as a number
    failed = [("number", m[1], m[2]) for m in matches if not m[3] and sum("0" <= c <= "9" for c in text[m[1] : m[2]]) >= FEWEST]
    free = _outside(kept)
    spans = [(k, a, b, True) for k, a, b in kept] + [(k, a, b, False) for k, a, b in failed + loose_matches(text, digit, title) if free(a, b)]
    spans.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    begin, ends = ({k: [x[i] for x in kept if x[0] == k] for k in BASE} for i in (1, 2))
    out = []
    for kind, a, b, base in dict.fromkeys(spans):
        s = text[a:b] if b - a <= 256 else text[a : a + 256]
        words = [w.lower() for w in _WORD.findall(text[max(0, a - LEFT) : a])][-3:]
        cue = 1 if any(w in CUES[kind] for w in words) else -1 if any(w in COUNTER_CUES for w in words) else 0
        before, after = text[a - 1 : a], text[b : b + 1]
        stuck = any(c.isalnum() or c in "_/=" for c in (before, after) if c)
        near = any(_near(begin[other], ends[other], a, b) for other in BASE if other != kind)
        votes = (_shape(kind, s, base), _gazetteer(kind, s), cue, -1 if stuck else 1, int(near), _filler(s))
        k = KINDS.index(kind)
        features = [_hash("kind", k), *(_hash("vote", k, j, v) for j, v in enumerate(votes)), _hash("all", *votes)]
        features += [_hash("word", words[-1] if words else ""), _hash("size", k, min(40, len(s)) // 4), _hash("sides", before if not before.isalnum() else "a", after if not after.isalnum() else "a")]
        out.append(Candidate(k, a, b, base, sum((v + 1) * 3**j for j, v in enumerate(votes)), tuple(sorted(set(features)))))
    return out


def _hints(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text whether it holds an @ or a bracket, and whether a digit."""
    flags = []
    for chars in (b"@[(", b"0123456789"):
        table = np.zeros(256, bool)
        table[list(chars)] = True
        places = np.flatnonzero(table[raw])
        flags.append(np.searchsorted(places, offsets[1:]) > np.searchsorted(places, offsets[:-1]))
    return flags[0], flags[1]


def _texts(column) -> Iterator[tuple[int, list[Candidate]]]:
    """(row, its candidates) of the texts that hold any."""
    raw, offsets = buffers(column)
    at, digit = _hints(raw, offsets)
    for row in range(len(offsets) - 1):
        data = raw[offsets[row] : offsets[row + 1]].tobytes()
        title = any(m in data for m in _MARKS)
        if at[row] or digit[row] or title:
            if found := candidates(data.decode(), bool(at[row]), bool(digit[row]), title):
                yield row, found


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [c for _, found in _texts(batch.column("text")) for c in found]
        yield pa.RecordBatch.from_arrays([pa.array([c.kind for c in rows], pa.int32()), pa.array([c.votes for c in rows], pa.int32()), pa.array([c.features for c in rows], pa.list_(pa.int32()))], names=["kind", "votes", "features"])


@dataclass
class Model:
    weight: np.ndarray
    #: By labeler, truth and vote: how likely; by kind: how common true spans are.
    reliability: np.ndarray
    prior: np.ndarray

    def score(self, features: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weight[list(features)].sum(), -500, 500))))


def agree(kind: np.ndarray, votes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posteriors of the patterns, reliabilities, priors) by EM; votes: patterns by labelers, in -1, 0, 1. Begins with the majority."""
    post = 1 / (1 + np.exp(-votes.sum(axis=1).astype(float)))
    prior = np.full(len(KINDS), 0.5)
    reliability = np.full((votes.shape[1], 2, 3), 1 / 3)
    for _ in range(ROUNDS):
        for k in range(len(KINDS)):
            own = kind == k
            prior[k] = ((post * count)[own].sum() + 1) / (count[own].sum() + 2)
        for j in range(votes.shape[1]):
            for truth, p in ((0, 1 - post), (1, post)):
                held = np.bincount(votes[:, j] + 1, weights=p * count, minlength=3) + 1
                reliability[j, truth] = held / held.sum()
        log = np.zeros((len(kind), 2))
        for truth in (0, 1):
            log[:, truth] = np.log(prior[kind] if truth else 1 - prior[kind]) + sum(np.log(reliability[j, truth, votes[:, j] + 1]) for j in range(votes.shape[1]))
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
    return post, reliability, prior


def train(features: list[list[int]], target: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Weights by Adam over full batches; targets are probabilities."""
    w, mean, square = (np.zeros(BUCKETS) for _ in range(3))
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    at = np.array([x for f in features for x in f], np.int64)
    share = np.sqrt(count)  # frequent rows count more, but don't rule
    share = share / max(1e-9, share.sum())
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[at], minlength=len(features)), -500, 500)))
        grad = np.bincount(at, weights=((p - target) * share)[row], minlength=BUCKETS) + RIDGE * w / max(1, len(features))
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w


def unpacked(votes: np.ndarray) -> np.ndarray:
    return np.stack([votes // 3**j % 3 - 1 for j in range(LABELERS)], axis=1) if len(votes) else np.zeros((0, LABELERS), np.int64)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Labelers' reliabilities and the span classifier, from all candidates of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    seen = texts.mapInArrow(trimmed(_count_task), "kind int, votes int, features array<int>").groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n"))
    path = scratch.folder(spark)
    seen = scratch.save(seen, f"{path}/seen")
    told = seen.groupBy("kind", "votes").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).orderBy("kind", "votes").collect()  # 3**6 a kind at most
    kind, votes, count = (np.array([r[c] for r in told], np.int64) for c in ("kind", "votes", "n"))
    post, reliability, prior = agree(kind, unpacked(votes), count)
    rows = np.bincount(kind, weights=[r["rows"] for r in told], minlength=len(KINDS)) if told else np.zeros(len(KINDS))
    share = F.element_at(F.array(*(F.lit(min(1.0, sample / max(1.0, r))) for r in rows)), F.col("kind") + 1)
    taken = seen.filter(F.pmod(F.xxhash64("kind", "votes", "features"), F.lit(1 << 20)) < share * (1 << 20))
    held = taken.orderBy("kind", "votes", "features").collect()
    scratch.drop(spark, path)
    truth = {(int(k), int(v)): p for k, v, p in zip(kind, votes, post, strict=True)}
    target = np.array([truth[r["kind"], r["votes"]] for r in held])
    weight = train([r["features"] for r in held], target, np.array([r["n"] for r in held], float)) if held else np.zeros(BUCKETS)
    return Model(weight, reliability, prior)


def spans_of(found: list[Candidate], model: Model, least: float) -> list[tuple[int, int, int, float, bool]]:
    """(kind, start, end, score, base) of the base spans and of the likely others, by kind and start."""
    out = [(c.kind, c.start, c.end, model.score(c.features), True) for c in found if c.base]
    likely = [(-p, c.kind, c.start, c.end) for c in found if not c.base for p in [model.score(c.features)] if p > least]
    covered = np.zeros(max((x[3] for x in likely), default=0), bool)  # candidates overlap no base span
    for p, k, a, b in sorted(likely):
        if not covered[a:b].any():
            covered[a:b] = True
            out.append((k, a, b, -p, False))
    return sorted(out)


def _scan_task(model: Model, least: float):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, found in _texts(batch.column("text")):
                out[row] = [{"kind": KINDS[k], "start": a, "end": b, "score": p, "base": own} for k, a, b, p, own in spans_of(found, model, least)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    return task


def scan(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id and spans (kind, start, end, score, base), by kind in the order of KINDS, then by start."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(_scan_task(model, least)), "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double,base:boolean>>")


def digests(found: DataFrame) -> DataFrame:
    """The columns that the registered query returns."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
