"""Operator 4: personal data by fixed patterns and a semi-Markov conditional random field.

The fixed patterns (email, ip, card, phone) give the base spans, leftmost and
non-overlapping per kind; all of them stay. The field adds spans of the same kinds that
are written in ways the patterns miss. It scores whole candidate segments (digit grouping,
checksum, separators, neighbours, the word before), not single characters, and a dynamic
programme over segments of at most ``MAX_TOKENS`` tokens chooses boundaries and kinds
together, against the alternative that each token stands alone. Base spans are fixed
points of the decoding: no added span overlaps one.

The weights are learned by conditional likelihood (forward-backward over segmentations) from a
bounded sample: at most ``snippets`` short windows around base spans and around other digits
of the corpus, with base spans as the truth, and the same windows with the span rewritten
in another form (without the plus, dotted, spelled ``[at]``). Only groupings seen as personal data
there can be added. The model is a table of weights of that bounded size, broadcast to the tasks.

Searches are linear in the text also where a pattern would backtrack (long runs of
digits or of address characters), and windows are cut at ``MAX_TOKENS`` tokens from a trigger.

Cases: null text has no spans; null ids and repeated rows stay rows of their own; an empty
table gives an empty result (and an empty model adds nothing); other columns are ignored.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
REACH = 96  # characters around a trigger
MARGIN = 1.0  # an added span must beat its tokens standing alone by this much
RESULT = ("doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
          "spans string, n_added bigint")

# Fixed patterns, split at points where they cannot match otherwise, so that each is linear.
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[0-9]+")
TRIGGER = re.compile(r"[0-9]{2}|@|[\[({] ?at ?[\])}]", re.I)
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\W\d_A-Za-z]+|\s|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """At each @, the run of address characters before it (after the last match) and a domain behind."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    found = []
    for chain in DOTTED.finditer(text):
        parts = chain.group().split(".")
        at = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in four):
                found.append((at, end))
            at = end + 1
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base spans by start, then kind as listed."""
    spans = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        spans += [("ip", a, b) for a, b in addresses(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", m.start(), m.end()))
        if "+" in text:
            spans += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m.group())) <= 15]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# The field --------------------------------------------------------------------------------

def _side(c: str) -> str:
    return "end" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c


def number_features(kind: str, text: str, a: int, b: int, word: str) -> list[str]:
    span = text[a:b]
    digits = "".join(DIGIT.findall(span))
    shape = re.sub(r"[0-9]+", lambda m: str(len(m.group())), span)
    parts = span.split(".")
    quad = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    return [f"{kind}|shape={shape}", f"{kind}|digits={len(digits)}", f"{kind}|luhn={luhn(digits)}", f"{kind}|quad={quad}",
            f"{kind}|before={_side(text[a - 1:a])}", f"{kind}|after={_side(text[b:b + 1])}", f"{kind}|word={word}", kind]


def email_features(text: str, a: int, b: int, word: str) -> list[str]:
    span = text[a:b]
    marked = re.sub(r"(?<![A-Za-z0-9])(at|dot)(?![A-Za-z0-9])", lambda m: "\x01" if m[1].lower() == "at" else "\x02", span, flags=re.I)
    shape = re.sub(r"x(?:[._%+-]x)+", "x", re.sub(r"[A-Za-z0-9]+", "x", marked))
    shape = re.sub(r"((?:[^x]*\x02[^x]*)x)\1+", r"\1", shape).replace("\x01", "AT").replace("\x02", "DOT")
    return [f"email|shape={shape}", f"email|last={min(len(span) - 1 - max(span.rfind('.'), span.rfind(' ')), 5)}",
            f"email|before={_side(text[a - 1:a])}", f"email|after={_side(text[b:b + 1])}", f"email|word={word}", "email"]


def _tokens(text: str) -> list[tuple[int, int, str]]:
    def kind(c: str) -> str:
        return "9" if c in "0123456789" else "a" if c.isascii() and c.isalpha() else "w" if c.isalpha() else "_" if c.isspace() else c

    return [(m.start(), m.end(), kind(m.group()[0])) for m in TOKEN.finditer(text)]


def candidates(text: str, tokens: list, blocked: list[tuple[int, int]]) -> list[tuple[int, int, str, list[str]]]:
    """(first token, end token, kind, features) of the segments that may be personal data."""
    covered = {x for a, b in blocked for x in range(a, b)}
    free = [t[0] not in covered and t[1] - 1 not in covered for t in tokens]
    out = []
    n = len(tokens)
    for i in range(n):
        if not free[i]:
            continue
        word = ""
        for j in range(i - 1, max(-1, i - 4), -1):
            if tokens[j][2] in "aw":
                word = text[tokens[j][0]:tokens[j][1]].lower()
                break
        a = tokens[i][0]
        if tokens[i][2] in "9+(" and (i == 0 or tokens[i - 1][2] != "9"):
            digits = 0
            for j in range(i, min(n, i + MAX_TOKENS)):
                t = tokens[j]
                if not free[j] or t[2] not in "9+(). -/_" or t[2] == "+" and j > i or t[1] - a > 40:
                    break
                digits += (t[1] - t[0]) * (t[2] == "9")
                if digits > 19:
                    break
                if t[2] == "9" and digits >= 7:
                    out += [(i, j + 1, k, number_features(k, text, a, t[1], word)) for k in KINDS[1:]]
        if tokens[i][2] in "a9" and (i == 0 or tokens[i - 1][2] not in "a9"):
            seen_at = False
            for j in range(i, min(n, i + MAX_TOKENS)):
                t = tokens[j]
                if not free[j] or t[2] not in "a9._%+-@_[](){}" or t[1] - a > 120 or text[t[0]] == "\n":
                    break
                is_at = t[2] == "@" or text[t[0]:t[1]].lower() == "at" and j > i
                if is_at and seen_at:
                    break
                seen_at = seen_at or is_at
                if seen_at and t[2] == "a" and text[t[0]:t[1]].lower() not in ("at", "dot"):
                    out.append((i, j + 1, "email", email_features(text, a, t[1], word)))
    return out


def _alone(tokens: list) -> list[str]:
    return [f"O|{t[2]}" for t in tokens]


def train(windows: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-3) -> dict[str, float]:
    """Weights by stochastic gradient on the conditional likelihood of the true segmentations."""
    weights: dict[str, float] = defaultdict(float)
    prepared = []
    for text, gold in windows:
        tokens = _tokens(text)
        starts, ends = {t[0]: i for i, t in enumerate(tokens)}, {t[1]: i + 1 for i, t in enumerate(tokens)}
        wanted = {(starts[a], ends[b], k) for k, a, b in gold if a in starts and b in ends}
        segments = candidates(text, tokens, [])
        if len(wanted) == len(gold) and wanted <= {s[:3] for s in segments}:
            prepared.append((_alone(tokens), segments, wanted))
    order = random.Random(4)
    for _ in range(epochs):
        order.shuffle(prepared)
        for alone, segments, wanted in prepared:
            n = len(alone)
            by_end, by_start = defaultdict(list), defaultdict(list)
            for s in segments:
                x = sum(weights[f] for f in s[3])
                by_end[s[1]].append((s, x))
                by_start[s[0]].append((s, x))
            ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                ahead[j] = _log_sum([ahead[j - 1] + weights[alone[j - 1]], *[ahead[s[0]] + x for s, x in by_end[j]]])
            for i in range(n - 1, -1, -1):
                behind[i] = _log_sum([behind[i + 1] + weights[alone[i]], *[behind[s[1]] + x for s, x in by_start[i]]])
            covered = {t for i, j, _ in wanted for t in range(i, j)}
            step: dict[str, float] = defaultdict(float)
            for i in range(n):
                p = math.exp(ahead[i] + weights[alone[i]] + behind[i + 1] - ahead[n])
                step[alone[i]] += (i not in covered) - p
            for end in by_end.values():
                for s, x in end:
                    g = (s[:3] in wanted) - math.exp(ahead[s[0]] + x + behind[s[1]] - ahead[n])
                    for f in s[3]:
                        step[f] += g
            for f, g in step.items():
                weights[f] += rate * (max(-2.0, min(2.0, g)) - decay * weights[f])
    positive = {f for _, segments, wanted in prepared for s in segments if s[:3] in wanted for f in s[3] if "|shape=" in f}
    return {f: w for f, w in weights.items() if "|shape=" not in f or f in positive}


def _log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def decode(text: str, weights: dict[str, float], blocked: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The best segmentation's spans (Viterbi over segments), outside the blocked ranges."""
    tokens = _tokens(text)
    by_end = defaultdict(list)
    get = weights.get
    alone = [get(f, 0.0) for f in _alone(tokens)]
    for s in candidates(text, tokens, blocked):
        if s[3][0] in weights:
            by_end[s[1]].append((s, sum(get(f, 0.0) for f in s[3]) - MARGIN))
    if not by_end:
        return []
    best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
    for j in range(1, len(tokens) + 1):
        best[j] = best[j - 1] + alone[j - 1]
        for s, x in by_end.get(j, ()):
            if best[s[0]] + x > best[j]:
                best[j], back[j] = best[s[0]] + x, s
    spans, j = [], len(tokens)
    while j > 0:
        s = back[j]
        if s:
            spans.append((s[2], tokens[s[0]][0], tokens[j - 1][1]))
        j = s[0] if s else j - 1
    return spans[::-1]


def all_spans(text: str, weights: dict[str, float]) -> tuple[list, list]:
    """(base spans, all spans) of a text."""
    base = base_spans(text)
    if not weights:
        return base, base
    taken: list[list[int]] = []  # base spans, overlapping ones together
    for _, a, b in base:
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts, ends = [t[0] for t in taken], [t[1] for t in taken]
    windows: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        at = bisect_right(starts, m.start()) - 1
        if at >= 0 and m.start() < ends[at]:
            continue
        low, high = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if windows and low <= windows[-1][1]:
            windows[-1][1] = high
        else:
            windows.append([low, high])
    added = []
    for low, high in windows:
        near = taken[bisect_right(ends, low):bisect_left(starts, high)]
        added += [(k, a + low, b + low) for k, a, b in decode(text[low:high], weights, [(a - low, b - low) for a, b in near])]
    return base, sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if added else base


# Spark --------------------------------------------------------------------------------------

def _rewritten(kind: str, span: str) -> list[str]:
    """Other ways to write the same datum, as training truth."""
    digits = "".join(DIGIT.findall(span))
    if kind == "phone" and len(digits) >= 10:
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits[:-10]} {a} {b} {c}"]
    if kind == "email":
        local, _, domain = span.partition("@")
        return [f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local}(at){domain}", f"{local} (at) {domain.replace('.', ' (dot) ')}"]
    return []


SHARE = 2  # windows of a text and kind at most


def text_windows(text: str, reach: int = 40) -> list[tuple[str, str]]:
    """(kind, snippet): for each kind up to ``SHARE`` windows around base spans, and one around other digits ('').

    Which ones is decided by a hash of their place in the text, so that any place is as likely as any other.
    """
    base = base_spans(text)
    rank = lambda at: zlib.crc32(f"{at}:{len(text)}".encode())
    out = []
    for kind in KINDS:
        own = sorted(((a, b) for k, a, b in base if k == kind), key=lambda s: rank(s[0]))[:SHARE]
        out += [(kind, text[max(0, a - reach):b + reach]) for a, b in own]
    # Places within reach of a base span are left out; their spans are merged first, so that each digit asks one of them.
    merged: list[list[int]] = []
    for a, b in sorted((a - reach, b + reach) for _, a, b in base):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts, best = [a for a, _ in merged], None
    for m in DIGITS.finditer(text):
        i = bisect_right(starts, m.start()) - 1
        if i < 0 or m.start() >= merged[i][1]:
            best = min(best or (1 << 32, 0), (rank(m.start()), m.start()))
    if best is not None:
        out.append(("", text[max(0, best[1] - reach):best[1] + 2 * reach]))
    return out


def _windows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        rows = [w for text in batch.column(0).to_pylist() for w in text_windows(text)]
        cols = list(zip(*rows)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string())], names=["kind", "snippet"])


def fit(docs: DataFrame, snippets: int = 400, sampled: int = 20_000) -> dict[str, float]:
    """Weights of the field from at most ``snippets`` windows, an equal share of each kind, and half as many without, of about ``sampled`` documents."""
    texts = docs.select(whole_text().alias("text"))
    share = min(1.0, sampled / max(1, texts.count()))
    seen = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)).mapInArrow(_windows, "kind string, snippet string")
    seen = seen.distinct().withColumn("h", F.xxhash64("snippet"))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("h", "snippet"))
    most = F.when(F.col("kind") == "", snippets // 2).otherwise(snippets // len(KINDS))
    chosen = (seen.withColumn("nth", nth).filter(F.col("nth") <= snippets // 2).filter(F.col("nth") <= most)
              .orderBy(F.col("kind") == "", "h", "snippet").collect())  # bounded by snippets
    windows = []
    for text in dict.fromkeys(r["snippet"] for r in chosen):
        gold = base_spans(text)
        windows.append((text, gold))
        for kind, a, b in gold[:1]:
            if len(gold) == 1:
                for other in _rewritten(kind, text[a:b]):
                    windows.append((text[:a] + other + text[b:], [(kind, a, a + len(other))]))
    return train(windows) if any(gold for _, gold in windows) else {}


def find(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """doc_id, base counts per kind, base_sha256, spans (base and added), n_added for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text, shared.value)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                out.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base)))
            cols = list(zip(*out)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]],
                                             names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, RESULT)


def masked(text: str, spans) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The rows of ``docs`` with personal data masked; ``n_chars``, if there, follows the text. Null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: t if t is None else masked(t, all_spans(t, shared.value)[1]), na_action="ignore")

    out = docs.withColumn("text", mask(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
