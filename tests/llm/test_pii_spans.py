import hashlib
import random
import re
import time
from collections import Counter

from stmtflow.llm import pii_spans as ps

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 12 <= len(digits) <= 19 and ps.luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_spans_equal_the_patterns():
    r = random.Random(1)
    parts = ["1", "2", "25", "0", "9", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "é", "_", "4111111111111111", "1.2.3.4", "\n"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 30)))
        assert ps.base_spans(text) == brute(text), text


def test_searches_are_linear():
    began = time.time()
    for text in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "+1" + "(" * 100_000, "1." * 100_000):
        ps.all_spans(text, {"email|shape=x@x": 1.0})
    assert time.time() - began < 30


def training():
    r = random.Random(2)
    windows = []
    for i in range(60):
        phone = f"+1 ({r.randrange(200, 999)}) {r.randrange(200, 999)}-{r.randrange(1000, 9999)}"
        mail = f"bob.{i}@mail{r.randrange(9)}.example.com"
        for kind, span in (("phone", phone), ("email", mail)):
            for other in (span, *ps._rewritten(kind, span)):
                windows.append((f"text before {other} and after", [(kind, 12, 12 + len(other))]))
        windows.append((f"item {r.randrange(10**5)} costs {r.randrange(10**9)} on 2021-0{r.randrange(9)}-11", []))
    return windows


def test_field_finds_other_spellings_and_nothing_else():
    weights = ps.train(training())
    found = lambda t: [(k, t[a:b]) for k, a, b in ps.all_spans(t, weights)[1]]
    assert found("please call 736-555-2678 now") == [("phone", "736-555-2678")]
    assert found("please write amy.7 [at] mail3 [dot] example [dot] org today")[0][0] == "email"
    assert found("on 2021-03-04 we sold 12345678 items at 10:30") == []
    assert found("look at the dot com boom") == []
    text = "mail a.b@c.de or 10.0.0.1"
    assert found(text) == [("email", "a.b@c.de"), ("ip", "10.0.0.1")]


def test_query(spark, sf_small):
    from stmtflow.llm.catalog import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = QUERIES["op4_pii"](spark, sf_small).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(ps.written(base).encode()).hexdigest()
        assert {ps.written([s]) for s in base} <= set(r.spans.split(",")) | {""}


def test_odd_rows(spark, odd_docs, no_docs):
    weights = ps.fit(odd_docs)
    got = ps.find(odd_docs, weights).collect()
    assert len(got) == odd_docs.count()
    ten = next(r for r in got if r.doc_id == 10)
    assert (ten.n_email, ten.n_phone) == (1, 1)
    assert ps.fit(no_docs) == {} and ps.find(no_docs, {}).count() == 0
    masked = ps.redact(odd_docs, weights)
    assert masked.columns == odd_docs.columns and masked.count() == odd_docs.count()
    text = masked.filter("doc_id = 10").first().text
    assert "a.b@c.de" not in text and "[email]" in text and "[phone]" in text
    assert masked.filter("doc_id = 0").first().text is None
    assert ps.redact(no_docs, weights).count() == 0


def test_training_windows_come_from_the_whole_text():
    """Any place is as likely, and no kind takes the others' room."""
    at = [ps.text_windows("x 7 " * n + "10.0.0.1 " + "y " * (400 - n) + "b@c.de " + "z " * 300) for n in range(0, 300, 7)]
    assert all([k for k, _ in w].count("ip") == 1 and [k for k, _ in w].count("email") == 1 for w in at)
    many = "".join(f"a{i}@b{i}.org " + "word " * 12 for i in range(200)) + "4111 1111 1111 1111 " + "w " * 60 + "99 " + "w " * 60 + "98"
    found = ps.text_windows(many)
    assert [k for k, _ in found] == ["email", "email", "card", ""]
    assert not any("a0@" in w or "a1@" in w for k, w in found if k == "email")


def segmentations(n, segments):
    """All ways to cover n tokens by segments and tokens standing alone, as lists of segments."""
    if n == 0:
        yield []
        return
    for rest in segmentations(n - 1, segments):
        yield rest
    for s in segments:
        if s[1] == n:
            for rest in segmentations(s[0], segments):
                yield [*rest, s]


SHORT = ["call 555 123 4567 now", "10.1.2.3 or 4111 1111 1111 1111", "a [at] b [dot] org, 0049 30 123 4567", "x 1234567 y 7654321"]


def test_decoding_equals_enumeration():
    rng = random.Random(6)
    for text in SHORT:
        tokens = ps._tokens(text)
        segments = ps.candidates(text, tokens, [])
        assert segments
        for _ in range(5):
            weights = {f: rng.uniform(-2, 2) for s in segments for f in s[3]} | {f: rng.uniform(-1, 1) for f in ps._alone(tokens)}

            def score(chosen):
                covered = {t for i, j, *_ in chosen for t in range(i, j)}
                return (sum(weights[f] for f, i in zip(ps._alone(tokens), range(len(tokens))) if i not in covered)
                        + sum(sum(weights[f] for f in s[3]) - ps.MARGIN for s in chosen))

            best = max(segmentations(len(tokens), segments), key=score)
            got = ps.decode(text, weights, [])
            chosen = [s for s in segments if (s[2], tokens[s[0]][0], tokens[s[1] - 1][1]) in got]
            assert len(chosen) == len(got) and abs(score(chosen) - score(best)) < 1e-9


def test_training_step_equals_enumeration():
    """From weights of zero all segmentations are equally likely: one step moves by the true counts less their mean."""
    gold = {"call 555 123 4567 now": [("phone", 5, 17)], "x 1234567 y 7654321": [("phone", 2, 9)]}
    for text, spans in gold.items():
        tokens = ps._tokens(text)
        segments, alone = ps.candidates(text, tokens, []), ps._alone(tokens)

        def counts(chosen):
            covered = {t for i, j, *_ in chosen for t in range(i, j)}
            return Counter([f for i, f in enumerate(alone) if i not in covered] + [f for s in chosen for f in s[3]])

        every = [counts(c) for c in segmentations(len(tokens), segments)]
        true = counts([s for s in segments if (s[2], tokens[s[0]][0], tokens[s[1] - 1][1]) in spans])
        weights = ps.train([(text, spans)], epochs=1, rate=0.5, decay=0.0)
        assert weights
        for f, w in weights.items():
            step = true[f] - sum(c[f] for c in every) / len(every)
            assert abs(w - 0.5 * max(-2.0, min(2.0, step))) < 1e-9, f
