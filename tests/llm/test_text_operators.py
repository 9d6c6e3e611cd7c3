"""Operators on single texts, against plain versions of their contracts."""

import base64
import hashlib
import random
import time
import re

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tessella.llm import license as licenses  # noqa: E402
from tessella.llm import pii, quality  # noqa: E402
from tessella.llm.bpe import Encoder, encode_column  # noqa: E402
from tessella.llm.quality import quality_rules  # noqa: E402
from tessella.llm.shingles import shingle_set, shingles  # noqa: E402

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    each = [int(c) for c in digits[::-1]]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(each)) % 10 == 0


def plain_spans(text):
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15],
    }


def test_base_spans_are_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.2@-+ (0)9b5%_x\n") for _ in range(rng.randrange(60)))
        assert pii.find_spans(text) == plain_spans(text)
    card = "4111 1111 1111 1111"
    assert pii.find_spans(f"pay {card}.")["card"] == [(4, 4 + len(card))]


@pytest.mark.parametrize(
    "text, kind, hidden",
    [
        ("write to john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("jane dot doe at mail dot example dot org", "email", "jane dot doe at mail dot example dot org"),
        ("x jоhn@exаmple.com y", "email", "jоhn@exаmple.com"),
        ("call +４４ ２０７１８３８７５０ x", "phone", "+４４ ２０７１８３８７５０"),
        ("plus four four two zero seven one eight three eight seven five zero", "phone", "plus four four two zero seven one eight three eight seven five zero"),
        ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
        ("john@example(dot)com", "email", "john@example(dot)com"),
        ("mail john.doe at mail8.example.com now", "email", "john.doe at mail8.example.com"),
        ("4111–1111–1111–1111", "card", "4111–1111–1111–1111"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, hidden):
    base, spans = pii.all_spans(text)
    assert not any(base.values())
    assert [text[a:b] for a, b in spans[kind]] == [hidden]
    assert hidden not in pii.redacted(text)


def test_the_gate_hides_nothing(monkeypatch):
    plain = ["jose_garcia arroba ejemplo.es", "jean.dupont arobase exemple.fr", "john.doe AT mail8.example.com", "plus 44 207 183 8750", "(plus four four two zero seven one eight three eight seven five zero)"]
    words = "jose_garcia john.doe8 arroba AROBASE at AT @ Dot punkt point ejemplo.es example com plus Plus 44 207 183 8750 one TWO drei vier cinq seis oh ( ) ! , . [at] a@b.co the".split()
    rng = random.Random(8)
    texts = plain + ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "", "-", "\n"]) for _ in range(rng.randrange(1, 14))) for _ in range(20000)]
    gated = [pii.all_spans(t) for t in texts]
    assert all(any(spans.values()) for _, spans in gated[: len(plain)])
    monkeypatch.setattr(pii, "_may_hide", lambda text: True)
    assert gated == [pii.all_spans(t) for t in texts]


def test_plain_prose_stays():
    for text in ("look at example.com please", "he was at home", "one two three four five six seven", "the point (at least) was made", "", None):
        assert not any(pii.all_spans(text)[1].values())
        assert pii.redacted(text) == text


@pytest.mark.parametrize("part", ["a", "1", "@", "+1(", "1.", "a@", " ", "( ", "[ at", "a@b.co c [at] d.com ", "one 1 ", "a . b @ c . dd ", "1 dot ", "one two ", "\u0430", "plus 4 "])
def test_long_runs_are_linear(part):
    def took(n):
        began = time.process_time()
        pii.all_spans(part * (n // len(part)) + "(")
        return time.process_time() - began

    took(1000)
    short, long = min(took(40_000) for _ in range(3)), took(160_000)
    assert long < 8 * short + 0.1


def plain_statistics(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n")]
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked)]


def test_quality_counts():
    rng = random.Random(4)
    for text in [None, "", " \n", "é ü\x1cx\xa0y"] + ["".join(rng.choice(["a ", "b ", "c\n", "#", "dé ", "\t", "a b c d e "]) for _ in range(rng.randrange(80))) for _ in range(300)]:
        assert quality.text_statistics(text)[0] == plain_statistics(text)


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    good = [(i, " ".join(word() for _ in range(rng.randrange(60, 200))), "en", "s") for i in range(300)]
    bad = [(1000 + i, " ".join(word() + "$$%%" for _ in range(100)), "en", "s") for i in range(5)]
    odd = [(2000, None, None, None), (2001, "", "en", None), (2002, "a b", "en", "s"), (2003, "x y z w v " * 10, "en", "s"), good[0]]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, lang string, source string").withColumnRenamed("none", "g")
    rows = quality_rules(docs).collect()
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert len(rows) == len(good + bad + odd)
    assert all(kept[i] for i, *_ in good) and not any(kept[i] for i, *_ in bad + odd[:4])
    empty = spark.createDataFrame([], docs.schema)
    assert quality_rules(empty).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_encoding_is_the_librarys(vocabulary):
    import numpy as np
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = Encoder(vocabulary, public_tokenizers.PATTERN)
    rng = random.Random(3)
    parts = ["a", "b", "th", "er", " ", "  ", "\n", "é", "日本", "2024", "!!", "'s", "²", "😀", "\t", "\x1c", "\x85", "\xa0", "​", "xxxxxxxxxxxx"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(50)))
        packed = mine.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == theirs.encode_ordinary(text)
        assert mine.decode(packed) == text.encode()
    for c in "aeox!=- \n":
        text = c * 3001 + "ab" * 2000
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == theirs.encode_ordinary(text)


def test_join_is_associative(vocabulary):
    e = Encoder(vocabulary, public_tokenizers.PATTERN)
    rng = random.Random(6)
    for _ in range(300):
        a, b, c = ("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 20))).encode() for _ in range(3))
        ea, eb, ec = map(e.encode_bytes, (a, b, c))
        assert e.join(e.join(ea, eb), ec) == e.join(ea, e.join(eb, ec)) == e.encode_bytes(a + b + c)


def test_encode_column_round_trip(spark, vocabulary):
    docs = spark.createDataFrame([(1, "Héllo wörld"), (2, None), (3, ""), (1, "Héllo wörld")], "doc_id long, text string")
    rows = encode_column(docs, vocabulary, public_tokenizers.PATTERN).collect()
    assert all(r["decoded_sha256"] == hashlib.sha256(("Héllo wörld" if r["doc_id"] == 1 else "").encode()).hexdigest() for r in rows)
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)] == [0, 0] and len(rows) == 4


def test_license_retrieval_misses_nothing_contained():
    s = licenses.Scanner()
    rng = random.Random(2)
    for _ in range(400):
        _, template = rng.choice(licenses.TEMPLATES)
        words = template.split()
        if len(words) > 20:
            words[rng.randrange(len(words))] = "zzz"
        text = " ".join([*(rng.choice(["ab", "cd", "ef"]) for _ in range(rng.randrange(80))), *words, *(rng.choice(["gh", "ij"]) for _ in range(rng.randrange(80)))])
        have = set(shingles(licenses._normal(text)).tolist())
        wanted = {s.names[i] for i, t in enumerate(s.sets) if sum(int(x) in have for x in t) >= 0.75 * len(t)}
        assert {m[0] for m in s.scan([text])[0]} == wanted
    assert s.scan([None, "", "released under the mit license", "MIT"]) == [[], [], [("MIT", 1.0, 0, 5)], []]


def test_shingles_follow_the_words():
    assert len(shingle_set(None)) == len(shingle_set(" \n")) == 0
    assert len(shingle_set("a b")) == 1 and shingle_set("A  b\n").tolist() == shingle_set("a b").tolist()
    assert shingle_set("a b").tolist() != shingle_set("ab").tolist() != shingle_set("b a").tolist()
    assert len(shingle_set("a b c d e f g")) == 3 and len(shingle_set("x " * 50)) == 1
