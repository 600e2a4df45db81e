import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline as cp
    from tests.llm.test_stages import brute_classes

    from cladespark.llm import decontam, pii, quality, registry
    from cladespark.llm.common import keep, table

    docs = table(spark, SF, "documents")
    columns = docs.columns
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontaminate", "redact", "encode"]
    for name, stage in cp.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = keep(stage(spark, docs, SF))
        got = {r.doc_id: r for r in after.collect()}
        assert set(got) <= set(before) and len(got) == after.count()
        if name != "encode":
            assert after.columns == columns
        if name == "quality_rules":
            assert set(got) == {r.doc_id for r in quality.judge(docs, table(spark, SF, "labels")).where("kept").collect()}
        if name == "near_dedup":
            ids = sorted(before)
            classes = brute_classes([before[i] for i in ids])
            assert set(got) == {min(i for i, c in zip(ids, classes, strict=True) if c == k) for k in set(classes)}
        if name == "decontaminate":
            assert set(got) == set(before) - {r.doc_id for r in decontam.leaks(docs, table(spark, SF, "benchmark")).collect()}
        if name == "redact":
            assert all(not pii.base_spans(r.text)[0] for r in got.values()) and set(got) == set(before)
        if name == "encode":
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=registry.vocabulary("piece_bpe_32k.model"))
            assert all(np.frombuffer(r.ids, "<u4").tolist() == library.encode(before[i]) for i, r in got.items()) and set(got) == set(before)
        docs = after
    assert 0 < docs.count() < 200


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op2_url_filters", "op7_sharding", "op10_benchmark_decontamination"])
def test_sql_agrees(spark, name):
    from cladespark.llm import registry

    got = registry.queries()[name](spark, SF).toPandas()
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    order = lambda d: d[columns].astype(str).replace({"None": "nan", "<NA>": "nan"}).sort_values(columns).reset_index(drop=True)
    assert order(got).equals(order(want))


# run() against a version in plain Python ------------------------------------------------------------------------


def brute_quality_kept(rows, labels):
    """Which rows the rules keep: exact words and pairs instead of hashed ones, so only for texts far from the threshold."""
    from tests.llm.test_ops import WORDS, brute_quality

    quality = {}
    for i, q in labels:
        if i is not None and q is not None:
            quality[i] = min(q, quality.get(i, 1))
    words = [WORDS.findall(t or "") for _, t in rows]
    grams = [[(w,) for w in ws] + list(zip(ws, ws[1:], strict=False)) for ws in words]
    raw, target = Counter(g for gs in grams for g in gs), Counter(g for (i, _), gs in zip(rows, grams, strict=True) if quality.get(i) == 1 for g in gs)
    logs = [(lambda g, c=c, n=sum(c.values()): math.log((c[g] + 1) / (n + (1 << 16)))) for c in (target, raw)]
    score = [sum(logs[0](g) - logs[1](g) for g in gs) / max(1, len(gs)) for gs in grams]
    failed = [brute_quality(t)[-1] for _, t in rows]
    fit = [[s for (i, _), s, f in zip(rows, score, failed, strict=True) if not f and i is not None and quality.get(i) == q] for q in (0, 1)]
    cut = (min(fit[1]) + max(x for x in fit[0] if x < min(fit[1]))) / 2
    assert min(abs(s - cut) for s, f in zip(score, failed, strict=True) if not f) > 0.05
    return [r for r, s, f in zip(rows, score, failed, strict=True) if not f and s >= cut]


def brute_run(rows, labels, items, library):
    from tests.llm.test_ops import brute_base, brute_leaks
    from tests.llm.test_stages import brute_classes

    rows = brute_quality_kept(rows, labels)
    classes = brute_classes([t for _, t in rows])
    rows = [min((r for r, c in zip(rows, classes, strict=True) if c == k), key=lambda r: (r[0] is None, r[0] or 0)) for k in sorted(set(classes))]
    rows = [r for k, r in enumerate(rows) if not brute_leaks([(k, r[1])], items)]
    out = []
    for i, text in rows:
        for kind, a, b in sorted(brute_base(text), key=lambda x: -x[1]):
            text = f"{text[:a]}<{kind.upper()}>{text[b:]}"
        ids = library.encode(text)
        out.append((i, np.array(ids, "<u4").tobytes(), len(ids), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return sorted(out, key=repr)


def planted(rng):
    """Rows with every kind of case, the labels of some, and benchmark items."""
    def prose(n, letters="bcdfgl"):
        return [rng.choice(letters) + rng.choice("aeiou") + rng.choice("mnrst") + rng.choice("aeiou") for _ in range(n)]

    junk = ["win###", "buy$$$", "now|||", "click&&&", "xx<<", "%%zz"]
    rows = [(i, " ".join(prose(rng.randrange(40, 120)))) for i in range(60)]
    rows += [(i, " ".join(rng.choice(junk) for _ in range(50))) for i in range(60, 90)]
    labels = [(i, 1) for i in range(20)] + [(i, 0) for i in range(60, 75)] + [(None, 1), (3, None)]
    items = [(k, " ".join(prose(n, "hjkpqv"))) for k, n in enumerate((5, 9, 20, 30))] + [(9, None)]
    good = [t for _, t in rows[:60]]
    rows += [(100 + k, f"{good[20 + k]} {text} {good[30 + k]}") for k, (_, text) in enumerate(items[:4])]  # leaks
    rows += [(200, good[0]), (0, good[0]), (None, good[1]), (7, good[40] + " "), (201, good[2] + " more"), (202, " ".join(good[3].split()[:-1]))]  # copies
    rows += [(None, " ".join(prose(50))), (5, " ".join(prose(60))), (5, None), (300, ""), (301, "too short"), (302, "one two three four five six seven eight " * 12)]
    rows += [(400 + k, f"{' '.join(prose(30))} {x} {' '.join(prose(30))}") for k, x in enumerate(("a.b@c.org", "10.1.2.3", "4111 1111 1111 1111", "+1 (743) 555-3824"))]
    rng.shuffle(rows)
    return rows, labels, items


@pytest.mark.parametrize("seed", [1, 2])
def test_run_equals_brute_force(spark, tmp_path, seed):
    import corpus_pipeline as cp
    import sentencepiece

    from cladespark.llm import registry

    rows, labels, items = planted(random.Random(seed))
    save = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save("documents", [(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    save("labels", [(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int")
    save("benchmark", items, "item_id long, text string")
    want = brute_run(rows, labels, items, sentencepiece.SentencePieceProcessor(model_file=registry.vocabulary("piece_bpe_32k.model")))
    got = sorted(((r.doc_id, bytes(r.ids), r.n_tokens, r.decoded_sha256) for r in cp.run(spark, str(tmp_path)).collect()), key=repr)
    assert got == want and 40 < len(want) < len(rows) - 40
