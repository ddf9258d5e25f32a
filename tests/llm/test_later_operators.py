"""Token alignment, secret scan and importance resampling against brute force, and on edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphband.llm import importance_resampling, secret_scan, token_alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, n long, pair long, chunk long, spans string, n_words long, weight long, place long, key string"
MORE = [1, 2, 3, "s", 4, 5, 6, "k"]
NOTHING = hashlib.sha256(b"").hexdigest()


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, *MORE) for i, t in rows], SCHEMA).repartition(parts)


def byte_table():
    """Bytes of A's entries, from the published rule: printed bytes stand for themselves, others for the next characters from 256 on."""
    printed = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    spelled = {chr(b): b for b in printed}
    for b in range(256):
        if b not in printed:
            spelled[chr(256 + len(spelled) - len(printed))] = b
    return spelled


class Plain:
    """Both libraries on whole texts, and a walk over both lists of tokens."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.spelled = byte_table()

    def align(self, text):
        """(counts, groups, links) of one text."""
        none = ((0, 0, 0, 0), "", [])
        if not text:
            return none
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw_a = [bytes(self.spelled[c] for c in self.a.id_to_token(i)) for i in a]
        pieces = [self.b.id_to_piece(i) for i in b]
        raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        whole = (" " + text).encode()
        if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            return none
        i = j = 0
        at_a, at_b, links, groups, of_a, of_b = len(raw_a[0]), len(raw_b[0]), [], [], [a[0]], [b[0]]
        while True:
            links.append((a[i], b[j]))
            end_a, end_b = at_a <= at_b, at_b <= at_a
            if end_a and end_b:
                groups.append(",".join(map(str, of_a)) + "|" + ",".join(map(str, of_b)))
                of_a, of_b = [], []
            if end_a:
                i += 1
            if end_b:
                j += 1
            if i == len(a):
                return (len(a), len(b), len(groups), len(links)), ";".join(groups), links
            if end_a:
                of_a.append(a[i])
                at_a += len(raw_a[i])
            if end_b:
                of_b.append(b[j])
                at_b += len(raw_b[j])


ATOMS = ["a", " ", "  ", "\n", "\t", " \n", "\n ", "▁", "<s>", "</s>", "<|endoftext|>", "<0x41>", "'s", " 's", "the", "Thing", "12", "é", "日本語", "😀", "\u0085", "\x1c", "\x00", "é", "!!", "　", "<unk>", "\r\n", "  the"]


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    return [None, "", " ", *texts, *texts[:40], "x" * 3000, "the other thing " * 400, "ab\ncd " * 30]


def test_alignment(spark, plain, odd_texts):
    docs = table(spark, [(None if i == 7 else i // 2 * 3, t) for i, t in enumerate(odd_texts)])
    want, held = [], Counter()
    rows = docs.select("doc_id", "text").collect()
    for r in rows:
        counts, groups, links = plain.align(r["text"])
        held.update(set(links))
        want.append((r["doc_id"], counts, groups, links))
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    want = sorted((str(i), *c, sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, c, g, links in want)
    for size in (token_alignment.CHUNK, 300):
        found = token_alignment.align(docs, A, B, chunk=size)
        assert sorted((str(r["doc_id"]), *list(r)[1:]) for r in found.collect()) == want
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sum(w[1] > 0 for w in want) > 300
    assert token_alignment.align(docs.where("false"), A, B).count() == 0
    written = sorted((str(r["doc_id"]), r["groups"]) for r in token_alignment.groups(docs, A, B).collect())
    assert written == sorted((str(r["doc_id"]), plain.align(r["text"])[1]) for r in rows)


def test_alignment_of_parts(plain, odd_texts, monkeypatch):
    """Long texts in parts, small tables, and few units at once give the same."""
    texts = [t for t in odd_texts if t]
    tool = token_alignment.Pair(A, B)
    want = [(list(c), hashlib.sha256(g.encode()).hexdigest() if g else "") for c, g, _ in map(plain.align, texts)]
    monkeypatch.setattr(token_alignment, "SLICE", 7)
    monkeypatch.setattr(token_alignment, "NEW", 11)
    monkeypatch.setattr(token_alignment, "MAX_BYTES", 2000)
    monkeypatch.setattr(token_alignment.slices_of, "__defaults__", (7,))
    assert [x[:2] for x in token_alignment.aligned(tool, texts)] == want


def test_merge_path_pieces():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 60, 700):
        ends = [np.unique(np.append(rng.integers(1, 3 * n + 1, n), 3 * n)) for _ in range(2)]
        whole = token_alignment.merge_path(*ends, size=10**6)
        a, b = ends
        start_a, start_b = np.append(0, a[:-1]), np.append(0, b[:-1])
        links = [(i, j) for i in range(len(a)) for j in range(len(b)) if start_a[i] < b[j] and start_b[j] < a[i]]
        assert list(zip(*(x.tolist() for x in whole[:2]), strict=True)) == links
        assert [int(a[i]) for i in whole[2]] == sorted(set(a.tolist()) & set(b.tolist()))
        for size in (1, 2, 3, 17):
            assert all((x == y).all() for x, y in zip(whole, token_alignment.merge_path(*ends, size=size), strict=True))
            cut = token_alignment.crossings(a, b, np.arange(0, len(a) + len(b) + 1, size))
            assert (np.diff(cut) >= 0).all() and (np.diff(cut) <= size).all()


RANDOM = "0123456789abcdefABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz+/"


def words(rng, n):
    syllables = ["get", "Element", "by", "Name", "config", "tion", "er", "list", "View", "data", "user", "_", "path", "token"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(2, 6))) for _ in range(n))


def base_by_hand(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            found.append((m.start(), "assign", m.end()))
    for kind, pattern, least in (("access", r"AKIA[A-Z0-9]+", 18), ("hex", r"[0-9a-f]+", 16)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(found, key=lambda x: (x[0], ("assign", "access", "hex").index(x[1])))


def test_secret_scan(spark):
    rng = random.Random(9)
    draw = lambda n, of=RANDOM: "".join(rng.choice(of) for _ in range(n))
    planted = {}
    rows = []
    for i in range(300):
        text = words(rng, 60)
        if i % 3 == 0:
            text += f"\n{rng.choice(['password', 'Api_Key', 'TOKEN', 'apikey'])}{rng.choice([': ', ' = ', '=', chr(34) + ': ' + chr(34)])}{draw(rng.randint(8, 40))} end"
        if i % 5 == 0:
            text += f" é AKIA{draw(rng.randint(10, 16), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789')}."
        if i % 7 == 0:
            text += " " + draw(rng.randint(12, 40), "0123456789abcdef")
        if i % 11 == 1:
            planted[i] = draw(32)
            text += f" 日本 {planted[i]} ok"
        rows.append((i, text))
    rows += [(400, None), (401, ""), (402, "token=token:abcdefghijklmnop"), (403, "a" * 200_000), (404, "AKIA" * 9), (405, "ſecret=abcdefghijklmnop"), (None, "x"), rows[0], (406, "ab12" * 20_000)]
    docs = table(spark, rows)
    models = secret_scan.train(secret_scan.samples(docs))
    found = secret_scan.summary(secret_scan.scan(docs, models)).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    missed = false = 0
    for r in found:
        want = base_by_hand(texts[r["doc_id"]] or "")
        written = ",".join(f"{k}:{a}:{b}" for a, k, b in want)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(w[1] == k for w in want) for k in secret_scan.KINDS)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert [s for s in spans if s[0] != "model"] == [[k, str(a), str(b)] for a, k, b in want]
        assert [int(s[1]) for s in spans] == sorted(int(s[1]) for s in spans)
        added = [texts[r["doc_id"]][int(a) : int(b)] for k, a, b in spans if k == "model"]
        assert r["n_model"] == len(added)
        if r["doc_id"] in planted:
            missed += not any(planted[r["doc_id"]] in x or x in planted[r["doc_id"]] for x in added)
        elif r["doc_id"] is not None and r["doc_id"] < 300:
            false += sum(not x.startswith("AKIA") for x in added)  # those too short for the pattern are random strings
    assert missed <= 2 and not false
    empty = docs.where("false")
    assert secret_scan.scan(empty, secret_scan.train(secret_scan.samples(empty))).count() == 0


def test_secret_models_held_out(spark):
    """Given labelled samples, held-out strings are told apart; probabilities sum to one."""
    rng = random.Random(2)
    ordinary = [w for w in words(rng, 6000).split() if len(w) >= 8]
    secret = ["".join(rng.choice(RANDOM) for _ in range(rng.randint(16, 40))) for _ in range(600)]
    half = lambda x, k: x[k::2]
    rows = [(t, False) for t in ordinary] + [(t, True) for t in secret]
    rng.shuffle(rows)
    models = secret_scan.train(spark.createDataFrame(half(rows, 0) + [(None, True)], "text string, random boolean"))
    held = [(t, r) for t, r in half(rows, 1) if len(t) >= secret_scan.LEAST]
    said = models.score([t for t, _ in held]) >= secret_scan.ODDS
    truth = np.array([r for _, r in held])
    assert said[truth].mean() > 0.9 and not said[~truth].any()
    p = np.exp(secret_scan.log_probabilities(np.random.default_rng(0).integers(0, 3, secret_scan.SIZE**3)))
    assert np.allclose(p.reshape(-1, secret_scan.SIZE).sum(axis=1), 1)
    assert models.score(["", "abc", ""])[[0, 2]].tolist() == [0, 0]


def resampled_by_hand(rows, target, order):
    def features(text):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % 10_000 for k in range(1, order + 1) for i in range(len(w) - k + 1)]

    own = [(i, *features(t)) for i, t in rows]
    s, t = Counter(x for r in own for x in r[2]), Counter(x for text in target for x in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda x: math.floor(1000 * math.log((t[x] + 1) * (all_s + 10_000) / ((s[x] + 1) * (all_t + 10_000))))
    out = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    drawn = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0], r[3], r[2]))
    rank = {}
    for k, r in enumerate(drawn[: 10 * len(drawn) // 100]):
        rank.setdefault(r, []).append(k + 1)
    return sorted(((str(i), n, w, score, rank[i, m, n, w, score].pop(0) if rank.get((i, m, n, w, score)) else None) for i, m, n, w, score in out), key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_importance_resampling(spark, order, monkeypatch):
    rng = random.Random(order)
    vocabulary = ["Alpha", "beta2", "é", "ÀB", "x'y", "42", "don-t", "日本", "thé", "ZED"] + [f"w{i}" for i in range(60)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    common = [line(rng.randint(0, 9)) for _ in range(12)]
    text = lambda: "\n".join(rng.choice(common) if rng.random() < 0.6 else line(rng.randint(0, 12)) for _ in range(rng.randint(0, 9)))
    rows = [(i, text()) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "\n\n \n"), (None, text() + "\n" + line(30)), (503, line(40_000)), rows[3], rows[3], (504, rows[5][1]), (505, "ONE")]
    target = [None, "", *[line(15) for _ in range(30)], "alpha\nbeta2 w1 w2\n\nw3"]
    docs, goal = table(spark, rows), table(spark, list(enumerate(target)))
    want = resampled_by_hand(rows, target, order)
    found = importance_resampling.resample(docs, goal, order)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(((str(r["doc_id"]), *list(r)[1:]) for r in found.collect()), key=str) == want
    assert sum(w[4] is not None for w in want) > 12
    empty = docs.where("false")
    assert importance_resampling.resample(empty, goal).count() == 0
    assert importance_resampling.resample(docs, goal.where("false")).count() == len(rows)


def test_small_tables_of_lines(monkeypatch):
    """A full table hands on its sums."""
    lines = importance_resampling.Lines(2, importance_resampling.Buckets(97))
    at = lines.of(b"a b\na b\nc\n\nD e f g")
    for i in at:
        lines.times[i] += 1
    total = lines.sums()
    for x in lines.across(at):
        total[x] += 1
    w = b"a b a b c d e f g".split()
    want = Counter(zlib.crc32(x) % 97 for x in w + [b" ".join(w[i : i + 2]) for i in range(8)])
    assert {i: int(n) for i, n in enumerate(total) if n} == dict(want)
    lines.clear()
    assert not lines.place and not lines.held
