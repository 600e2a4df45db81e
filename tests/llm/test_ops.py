import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladespark.llm import decontam, pii, quality, registry, sentencepiece_codec, sharding, simhash, substring_dedup, token_counts, token_files, url_filter, wordhash
from cladespark.llm.common import shared_dir
from cladespark.llm.components import components
from cladespark.llm.piece_model import CONTROL, NORMAL, UNKNOWN, PieceModel

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, bucket int"


def frame(spark, rows):
    """Documents with nulls, and extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, None, len(t or ""), 1, "x", 2) for i, t in rows], DOCS)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6))) for _ in range(80)]
    passage = [rng.choice(vocabulary) for _ in range(90)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 160))]
        if i % 3 == 0:
            a = rng.randrange(0, 40)
            words[len(words) // 2 : len(words) // 2] = passage[a : a + rng.randrange(45, 60)]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 1, rows[3][1]), (n + 2, None), (None, rows[3][1]), (n + 3, ""), (n + 4, "é ü ß " * 40), (n + 5, "  \n "), (4, rows[0][1]), (n + 6, "x" * 5000 + " " + " ".join(passage) * 20)]
    return rows


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# 1 ------------------------------------------------------------------------------------------------------------


def brute_repeats(rows, window):
    first = {}
    for i, t in rows:
        w = WORDS.findall(t or "")
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORDS.findall(t or "")
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [1, 3, 12, 50])
def test_repeats_are_removed(spark, window):
    rows = corpus()
    got = substring_dedup.digest(substring_dedup.remove_repeats(frame(spark, rows), window))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows, window)


def test_covers_are_difference_covers():
    for v, d in substring_dedup.PERFECT_COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))
    assert substring_dedup.cover_for(50)[0] == 31


def test_word_hashes_do_not_depend_on_blocks():
    raw = np.frombuffer(("ab cde é " * 300).encode(), np.uint8)
    s, e, _ = wordhash.spans(raw, np.array([0, len(raw)]))
    assert (wordhash.word_hashes(raw, s, e) == wordhash.word_hashes(raw, s, e, block=7)).all()


# 2 ------------------------------------------------------------------------------------------------------------


def brute_verdict(url, rules, default="allow"):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    best = None
    for rule, verdict in rules:
        rh, _, rp = rule.partition("/")
        if (host == rh or host.endswith("." + rh)) and path.startswith("/" + rp) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best and best[0], best[1] if best else default


URLS = ["http://a.example.net/en/1", "https://example.net", "http://EXAMPLE.com/de/x?y#z", "http://x.org/fr/", "http://x.org/fr", "ftp://fr.org/frx", None, "", "no scheme", "://", "http:///de/", "http://notnet/", "http://b.net/?q=://c", "http://a.b.c.d.net/en/../x", "http://example.com/de", "http://b.example.com//de/", "http://ünï.NET/x", "http://example.com:80/de/", "http://e.net/en/deeper/and/deeper"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS[:3])] + [(None, URLS[0], None, None)], "page_id long, url string, host string, rule string")
    more = [*registry.RULES, ("net/en/deep", "allow"), ("b.net/", "allow")]
    for rules in (registry.RULES, more, []):
        got = url_filter.judge(pages, rules) if rules else url_filter.judge(pages, spark.createDataFrame([], "rule string, verdict string"))
        want = [(i, *brute_verdict(u, rules)) for i, u in enumerate(URLS + URLS[:3])] + [(None, *brute_verdict(URLS[0], rules))]
        assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted(want, key=repr)
    assert url_filter.judge(pages.where("false"), more).count() == 0


def test_url_shuffle_join_is_the_same(spark, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    want = rows_of(url_filter.judge(pages, registry.RULES), "page_id", "rule", "verdict")
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert rows_of(url_filter.judge(pages, registry.RULES), "page_id", "rule", "verdict") == want


# 3 and 8 ------------------------------------------------------------------------------------------------------


def odd_texts(seed=3, n=300):
    rng = random.Random(seed)
    letters = [*"  \n\t▁▁abc the ing 日本語是 éüß 🙂 ́<>/ABC.,==--_0123456789'\x00\x01", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "'s", "'ll"]  # special strings whole, too
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 120))) for _ in range(n)]
    return [*texts, "", " ", "\n\n", "a" * 3000, "ab" * 2000, "日本" * 900, " " * 900, "=" * 2000, "the" * 900]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=registry.vocabulary("piece_bpe_32k.model"))


def test_token_counts_equal_the_library(spark, library):
    texts = odd_texts()
    rows = [*enumerate(texts), (None, "a b"), (1, None), (1, texts[1])]
    got = token_counts.token_counts(frame(spark, rows), registry.vocabulary("piece_bpe_32k.model"), 100)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for i, t in rows]
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_prefix_scan_of_chunk_maps(library):
    _, machine, _ = token_counts._memory(registry.vocabulary("piece_bpe_32k.model"))
    rng = random.Random(8)
    for text in ("▁" + "internationalisation" * 60, "".join(rng.choice("abst") for _ in range(900)), "日本語です" * 90):
        for size in (1, 3, 64, 999):
            parts = [text[i : i + size] for i in range(0, len(text), size)]
            scanned = token_counts.prefix_scan(machine.chunk_maps(parts))
            state = total = 0
            for part, m in zip(parts, scanned, strict=True):  # against reading the chunks one after the other
                state, n = machine.run(part, state)
                total += n
                assert m[0] == (state, total)


def test_segments_hold_together_what_a_piece_can_span(library):
    from cladespark.llm import piece_model, segments

    path = registry.vocabulary("piece_bpe_32k.model")
    texts = odd_texts(9, 200)
    data, at, counts = segments.segments(path).of(texts)
    model, k = piece_model.load(path), 0
    pairs = {(a, b) for p in model.ids for a, b in zip(p[:-1], p[1:])}
    for t, n in zip(texts, counts.tolist(), strict=True):
        parts = [data[x:y].decode().replace(" ", "▁") for x, y in zip(at[k : k + n], at[k + 1 : k + n + 1])]
        k += n
        assert "".join(parts) == ("▁" + t.replace(" ", "▁") if t else "")
        assert not {(a[-1], b[0]) for a, b in zip(parts[:-1], parts[1:])} & pairs


def test_memory_is_bounded_and_skips_long_keys():
    from cladespark.llm.wordcache import LONG, Memory, distinct

    asked = []

    def encode(keys):
        asked.extend(keys)
        return np.array([x for k in keys for x in k[:3]], np.int32), np.array([min(3, len(k)) for k in keys])

    memory = Memory(encode, most=10, most_bytes=1000)
    rng = random.Random(1)
    for _ in range(30):
        words = [bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 1, 2, 4, LONG + 1]))) for _ in range(40)]
        keys, which = distinct(b"".join(words), np.cumsum([0, *map(len, words)]))
        assert [keys[i] for i in which] == words
        got, sizes = memory.joined(keys, which)
        assert got.tolist() == [x for w in words for x in w[:3]] and sizes.tolist() == [min(3, len(w)) for w in words]
        assert all(len(k) <= LONG for k in memory.index) and memory.held < 1000 + 40 * (LONG + 12)


def test_encoding_equals_the_library_and_comes_back(spark, library):
    path = registry.vocabulary("piece_bpe_32k.model")
    texts = odd_texts(5)
    rows = [*enumerate(texts), (None, None)]
    got = sentencepiece_codec.decode(sentencepiece_codec.encode(frame(spark, rows), path), path).collect()
    want = {i: (t or "") for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert list(r.ids) == library.encode(want[r.doc_id]) and r.decoded == want[r.doc_id].replace("▁", " ")
    both = {r.doc_id: r for r in sentencepiece_codec.round_trip(frame(spark, rows), path).collect()}
    for r in got:
        assert np.frombuffer(both[r.doc_id].ids, "<u4").tolist() == list(r.ids) and both[r.doc_id].decoded == r.decoded
    n = {r.doc_id: r.n_tokens for r in sentencepiece_codec.with_digests(sentencepiece_codec.round_trip(frame(spark, rows), path)).collect()}
    assert all(n[r.doc_id] == len(r.ids) for r in got)
    assert sentencepiece_codec.round_trip(frame(spark, [(1, "x")]).where("false"), path).count() == 0


def test_encoding_keeps_little_in_memory(library):
    import tracemalloc

    import pyarrow as pa

    path = registry.vocabulary("piece_bpe_32k.model")
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(4000)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    run = sentencepiece_codec._both(path)
    [*run(iter([batch.slice(0, 2)]))]  # the model, and what it learns
    codec, _ = sentencepiece_codec.codec(path)
    assert codec.own and not codec.own.rule.pairs
    tracemalloc.start()
    try:
        done = 0
        for out in run(iter([batch])):
            assert [r["decoded"] for r in out.to_pylist()] == texts[done : done + out.num_rows]
            first = out.slice(0, 1).to_pylist()[0]
            assert np.frombuffer(first["ids"], "<u4").tolist() == library.encode(texts[done])
            done += out.num_rows
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert done == len(texts) and most < 20 << 20, most


def test_unigram_viterbi_against_enumeration():
    rng = random.Random(2)
    pieces = ["<unk>", "<s>", "▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bb", "abab"]
    scores = [0.0, 0.0] + [-rng.random() * 5 for _ in pieces[2:]]
    model = PieceModel(pieces, scores, [UNKNOWN, CONTROL] + [NORMAL] * (len(pieces) - 2), bpe=False)
    codec = sentencepiece_codec.Codec(model)
    low = codec.unknown_score

    def best(text):
        table = [0.0] + [float("-inf")] * len(text)
        for i in range(1, len(text) + 1):
            for j in range(i):
                k = model.ids.get(text[j:i])
                if k is not None:
                    table[i] = max(table[i], table[j] + scores[k])
            if text[i - 1] not in model.ids:
                table[i] = max(table[i], table[i - 1] + low)
        return table[-1]

    for _ in range(200):
        text = "".join(rng.choice("▁abc") for _ in range(rng.randrange(1, 14)))
        ids = codec.pieces_of(text)
        assert abs(sum(scores[i] if i else low for i in ids) - best(text)) < 1e-9
        assert "".join("c" if not i else pieces[i] for i in ids) == text


# 4 ------------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    digits = lambda s: re.sub(r"\D", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans():
    rng = random.Random(8)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    bits = ["a@b.c", "x.y@", "@", "1.2.3.4", "300.1.1.1", "1.2.3", "4111 1111 1111 1111", "4111111111111111", "+1 (743) 555-3824", "+49", "12", " ", ".", "-", "é", "a", "..", "+", "(", "007.01.2.255"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 14)))
        assert pii.base_spans(text)[0] == brute_base(text), text


def card(rng):
    d = "".join(rng.choice("0123456789") for _ in range(15))
    return next(d + c for c in "0123456789" if pii.luhn(d + c))


def test_contexts_find_what_the_rules_miss(spark):
    rng = random.Random(4)
    rows = [(i, f"zahl {card(rng)} ende") for i in range(30)]
    two = f"{card(rng)} {card(rng)}"
    rows += [(100, f"x {two} y"), (101, "order 123456789012345678901234 done"), (102, None), (102, ""), (None, rows[0][1]), (103, f"x {two} y")]
    got = {(r.doc_id, r.spans): r for r in pii.find(frame(spark, rows)).collect()}
    r = next(r for r in got.values() if r.doc_id == 100)
    assert (r.n_card, r.n_found, r.spans) == (0, 2, "card:2:18,card:19:35")
    assert all(r.spans == "" for r in got.values() if r.doc_id in (101, 102))
    for r in got.values():
        base = pii.written(brute_base(dict((i, t) for i, t in rows)[r.doc_id] or ""))
        assert set(filter(None, base.split(","))) <= set(r.spans.split(",")) and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert sum(1 for _ in pii.find(frame(spark, rows)).collect()) == len(rows)


def test_candidates():
    at = lambda t: {t[s:e] for s, e in pii.candidates(t, *pii.base_spans(t))}
    assert {"4111 1111 1111 1111", "5500 0000 0000 0004"} <= at("4111 1111 1111 1111 5500 0000 0000 0004")  # two spaced cards in a row
    assert "020 7946 0958" in at("call 020 7946 0958 now") and "(415) 555 2671" in at("at (415) 555 2671.") and "555-123-4567" in at("tel:555-123-4567")
    assert "müller@exämple.de" in at("an müller@exämple.de bitte") and "jane dot doe (at) site dot org" in at("jane dot doe (at) site dot org") | {"jane dot doe (at) site dot org"}
    assert any("(at) site dot org" in x for x in at("write jane (at) site dot org soon"))
    assert at("in 1984 at 12 noon dot") == set() and at("9" * 30_000 + " x") == {"9" * 30_000} and len(at("12 34 " * 5_000)) < 20
    assert pii.plausible("müller@exämple.de") == ["email"] and pii.plausible("jane (at) site dot org") == ["email"]


def test_contexts_find_addresses_and_spaced_numbers(spark):
    rng = random.Random(14)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(i, f"kontakt: {name()}@{name()}.org schreiben") for i in range(30)] + [(i, f"ruf +49 {rng.randrange(10**9, 10**10)} an") for i in range(30, 60)]
    rows += [(100, "kontakt: jörg@bücher.org schreiben"), (101, "ruf 030 12345678 an"), (102, "jörg sagt bücher")]
    got = {r.doc_id: r.spans for r in pii.find(frame(spark, rows)).collect()}
    assert got[100] == "email:9:24" and got[101] == "phone:4:16" and got[102] == ""


def test_clashing_columns_and_long_texts(spark):
    long = "x " * 200_000 + "a@b.org"
    df = spark.createDataFrame([(1, "mail a@b.org now", "mine", 5, 7), (2, long, None, None, 1), (None, None, "k", 1, 2)], "doc_id long, text string, pii_spans string, pii_key long, k_id long")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert pii.redact(df).columns == df.columns and got[1].text == "mail <EMAIL> now" and got[1].pii_spans == "mine" and got[1].pii_key == 5
    assert got[2].text == long.replace("a@b.org", "<EMAIL>") and got[None].text is None and got[None].k_id == 2


def test_redaction_keeps_columns(spark):
    df = frame(spark, [(1, "mail a@b.org now"), (1, "mail a@b.org now"), (2, None), (None, "+1 (743) 555-3824"), (3, "clean")])
    got = pii.redact(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.where("doc_id is not null and text is not null").collect()) == [(1, "mail <EMAIL> now", 16), (1, "mail <EMAIL> now", 16), (3, "clean", 5)]
    assert got.where("doc_id is null").first().text == "<PHONE>"
    assert pii.redact(df.where("false")).count() == 0


# 5 ------------------------------------------------------------------------------------------------------------


def brute_quality(text):
    w = WORDS.findall(text or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    twice = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    failed = len(w) < 20 or 100 * len(twice) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice), failed


def test_quality(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["the", "of", "tree", "leaf", "branch", "and"]) for _ in range(60))
    poor = lambda: " ".join(rng.choice(["win###", "buy$$$", "now|||", "click&&&"]) for _ in range(60))
    rows = [(i, good() if i % 2 else poor()) for i in range(80)] + [(80, None), (81, ""), (None, good()), (82, ("one two three four five six seven eight nine\n" * 20)), (83, "é " * 30), (1, good())]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(frame(spark, rows), labels)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(((i, *brute_quality(t)) for i, t in rows), key=repr)
    for r in got.collect():  # held out: 40 to 79
        if r.doc_id is not None and 40 <= r.doc_id < 80:
            assert r.kept == bool(r.doc_id % 2)
    none = quality.judge(frame(spark, rows), labels.where("false"))
    assert none.where("kept = base_failed").count() == 0
    assert quality.judge(frame(spark, rows).where("false"), labels).count() == 0


def test_quality_counts_every_label(spark):
    """More labels of a class than round 2 fitted on (20,000): every one counts in the target and for the threshold."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdef" if i % 4 else "adghij") for _ in range(20))) for i in range(30_000)]
    known = {i: int(i % 4 > 0) for i in range(0, 29_000)}
    labels = spark.createDataFrame([(i, q, 0) for i, q in known.items()], "doc_id long, quality int, toxic int")
    grams = {i: t.split() + list(zip(t.split(), t.split()[1:], strict=False)) for i, t in rows}
    raw, target = Counter(g for gs in grams.values() for g in gs), Counter(g for i, gs in grams.items() if known.get(i) for g in gs)
    logs = {g: math.log((target[g] + 1) / (target.total() + (1 << 16))) - math.log((raw[g] + 1) / (raw.total() + (1 << 16))) for g in raw}
    score = {i: sum(logs[g] for g in gs) / len(gs) for i, gs in grams.items()}
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows), labels).collect()}
    assert max(abs(got[i].score - s) for i, s in score.items()) < 1e-9
    fine = {q: sorted(got[i].score for i, k in known.items() if k == q and not got[i].base_failed) for q in (0, 1)}
    most = fine[1][int(quality.REJECT_GOOD * len(fine[1]))]
    cut = (most + max(x for x in fine[0] if x < most)) / 2
    assert all(r.kept == (not r.base_failed and r.score >= cut) for r in got.values()) and len(fine[1]) > 20_000


# 6 ------------------------------------------------------------------------------------------------------------


def brute_print(text):
    import xxhash

    w = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    """prints: [(id, fingerprint)] -> least id over each class."""
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                root[find(b)] = find(a)
    least = defaultdict(list)
    for i, f in prints:
        if i is not None:
            least[find(f)].append(i)
    return [(i, f"{f:016x}", min(least[find(f)]) if least[find(f)] else None) for i, f in prints]


def test_simhash(spark):
    rng = random.Random(9)
    rows = corpus(2)
    for i in range(6):
        w = rows[i][1].split()
        for _ in range(3):
            if w:
                w[rng.randrange(len(w))] = "CHANGED"
        rows.append((200 + i, " ".join(w)))
    got = simhash.near_classes(frame(spark, rows)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f"), "component_id")
    assert rows_of(got, "doc_id", "f", "component_id") == sorted(brute_classes([(i, brute_print(t)) for i, t in rows]), key=repr)
    assert simhash.near_classes(frame(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("heavy", [4096, 3])
def test_links_keep_classes_whole(spark, heavy):
    rng = random.Random(10)
    prints = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(25):
            x = center
            for _ in range(rng.randrange(0, 6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, heavy).collect()
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3 for r in links)
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[find(r.a)] = find(r.b)
    want = brute_classes([(i, x % (1 << 64)) for i, x in enumerate(signed)])
    ours = defaultdict(list)
    for i, x in enumerate(signed):
        ours[find(x)].append(i)
    assert sorted(min(v) for v in ours.values() for _ in v) == sorted(c for _, _, c in want)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(900, 901)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in range(5, 40)} | {900: 900, 901: 900}


# 7 ------------------------------------------------------------------------------------------------------------


def test_shards(spark):
    rows = corpus(4)
    got = sharding.shard_by_bytes(frame(spark, rows), 16).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode())))
    size = [len((t or "").encode()) + 1 for _, t in order]
    total, before, slots, want = sum(size), 0, Counter(), []
    for (i, t), n in zip(order, size):
        shard = before * 16 // total
        want.append((i, n, zlib.crc32((t or "").encode()), shard, slots[shard]))
        slots[shard] += 1
        before += n
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got), key=repr) == sorted(want, key=repr)
    assert sharding.shard_by_bytes(frame(spark, rows).where("false"), 16).count() == 0


# 9 ------------------------------------------------------------------------------------------------------------


def test_packing_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 4, 5, 1000):
        v = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert (token_files.unpack(*token_files.pack(v), n) == v).all()
    ids = np.array([7, 7, 3, 9, 9, 9, 3])
    listed, place = token_files.ranking(np.bincount(ids, minlength=12))
    assert listed.tolist() == [9, 3, 7] and listed[place[ids]].tolist() == ids.tolist()


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = registry.vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    extra = ["İstanbul ΣΑΣ ς ﬁ", "a b c\x85d\x1ce", "<|startoftext|>x<|endoftext|>", "é vs é", "it's don't 12,5 … ½ ²", "Ǆ ǅ ſ µ ŉ"]
    rows = corpus(7, 40) + [(500 + i, t) for i, t in enumerate(extra + odd_texts(11, 60))]
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 400)
    out = token_files.write_tokens(frame(spark, rows), path, shared_dir(spark))
    got = token_files.read_tokens(spark, out).collect()
    count = np.bincount(np.concatenate([np.frombuffer(r.ids, "<u4") for r in got]))
    listed = np.frombuffer(spark.read.parquet(f"{out}/ranks").first().ranks, "<u4").tolist()
    assert listed == sorted(np.flatnonzero(count).tolist(), key=lambda i: (-count[i], i))  # by frequency over all documents
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == [0, *np.cumsum([r.n_tokens for r in order])[:-1].tolist()]
    ids = [r.doc_id for r in order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    ours = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=repr)
    assert ours == sorted(((i, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows), key=repr)
    assert token_files.read_tokens(spark, token_files.write_tokens(frame(spark, rows).where("false"), path, shared_dir(spark))).count() == 0


# 10 -----------------------------------------------------------------------------------------------------------


def brute_template(text):
    """(kind, value) of each word: a scanner of its own, character by character."""
    import unicodedata

    cat = lambda c: unicodedata.category(c)
    word = lambda c: cat(c)[0] == "L" or cat(c) == "Nd"
    out, i, n = [], 0, len(text)
    while i < n:
        if not word(text[i]):
            i += 1
            continue
        j = i
        if text[i] in "0123456789":
            while j < n and (text[j] in "0123456789" or (text[j] in ".," and j + 1 < n and text[j + 1] in "0123456789")):
                j += 1
            out.append(("N", text[i:j]))
        else:
            while j < n and word(text[j]):
                j += 1
            w, k = text[i:j], i + 1
            while k < j and cat(text[k]) == "Ll":
                k += 1
            inside = i >= 2 and text[i - 1] == " " and (cat(text[i - 2]) in ("Ll", "Nd") or text[i - 2] in ",;")
            if inside and cat(w[0]) == "Lu" and k > i + 1:
                out.append(("P", w.lower()))
            elif out and out[-1][0] == "N" and w.lower() in decontam.UNITS:
                out.append(("U", w.lower()))
            else:
                out.append((w.lower(), w.lower()))
        i = j
    return out


def brute_leaks(docs, items):
    out = {}
    for d, text in docs:
        a = brute_template(text or "")
        for item, passage in items:
            b = brute_template(passage or "")
            n = min(8, len(b))
            if len(b) < 3:
                continue
            met = defaultdict(set)
            for p in range(len(a) - n + 1):
                for q in range(len(b) - n + 1):
                    x, y = a[p : p + n], b[q : q + n]
                    if [k for k, _ in x] == [k for k, _ in y] and (sum(k not in "NPU" or not k.isupper() for k, _ in x) >= 2 or x == y):
                        met[p - q].add((q, tuple((k, v, u) for (k, v), (_, u) in zip(y, x) if k in ("N", "P", "U"))))
            at = set()
            for found in met.values():
                values = defaultdict(set)
                for _, slots in found:
                    for k, theirs, ours in slots:
                        values[k, theirs].add(ours)
                if all(len(v) == 1 for v in values.values()):
                    at |= {q for q, _ in found}
            covered = {j for q in at for j in range(q, q + n)}
            if at and len(covered) >= 0.5 * len(b):
                out[d, item] = len(at), len(covered), len(b)
    return out


def test_decontamination(spark):
    rng = random.Random(12)
    vocabulary = ["w" + "".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(500)]
    fill = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = "A train leaves with Alice at speed 62.5 km and meets a friend called Robert after 62.5 km of travel in the 3 hours that they had for it"
    swap = item.replace("Alice", "Wanda").replace("Robert", "Ulrich").replace("62.5", "1,250").replace(" km", " miles").replace("3 hours", "7 days")
    loose = item.replace("speed 62.5", "speed 85")  # one value of the item would stand for two
    numbers = "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"
    items = [(1, item), (2, fill(30)), (3, None), (4, "too short"), (5, numbers), (6, "It was Anna who called"), *((20 + n, fill(n)) for n in range(3, 15))]
    two = items[1][1]
    rows = [(10, f"{fill(40)} {item} {fill(40)}"), (11, f"{fill(13)} {swap} {fill(9)}"), (12, f"{fill(20)} {loose}"), (13, fill(300)), (14, None), (15, ""), (16, " | ".join(two.upper().split())), (None, two), (17, " ".join(two.split()[:9]) + " " + fill(50)), (18, "21 22 23 24 25 26 27 28 29 30 31 32 33 34 35"), (19, f"{fill(5)} {numbers}"), (20, "she said: It was Berta who called. " + "too short")]
    rows += [(1000 * n + at, f"{fill(20 + at)} {text} {fill(30)}") for n, text in items if n > 20 for at in range(5)]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, pos string")
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(frame(spark, rows), bench).collect()}
    assert {k: (r.n_windows, r.covered_words, r.item_words) for k, r in got.items()} == brute_leaks(rows, items)
    assert {(1000 * n + at, n) for n, _ in items if n > 20 for at in range(5)} <= set(got)  # every length at every place
    assert {k for k in got if k[0] is None or k[0] < 1000} >= {(10, 1), (11, 1), (16, 2), (None, 2), (19, 5)} and not {(12, 1), (18, 5), (20, 4)} & set(got)
    assert got[10, 1].n_changed == 0 and got[11, 1].n_changed > 0
    assert decontam.leaks(frame(spark, rows).where("false"), bench).count() == 0
    assert decontam.leaks(frame(spark, rows), bench.where("false")).count() == 0


def test_common_windows_and_blocks_of_hashes(spark, monkeypatch):
    words = "the same opening words stand in front of every question here "
    bench = spark.createDataFrame([(i, words + f"item{i} asks about thing{i} and what{i} it{i} does{i}") for i in range(40)], "item_id long, text string")
    docs = [(i, words + f"text{i}") for i in range(200)] + [(1000 + i, words + f"item{i} asks about thing{i} and what{i} it{i} does{i}") for i in range(0, 40, 7)]
    want = rows_of(decontam.leaks(frame(spark, docs), bench), "doc_id", "item_id", "n_windows", "covered_words")
    assert {(1000 + i, i) for i in range(0, 40, 7)} <= {x[:2] for x in want}
    monkeypatch.setattr(decontam, "BLOCK", 50)  # several passes
    assert rows_of(decontam.leaks(frame(spark, docs), bench), "doc_id", "item_id", "n_windows", "covered_words") == want
