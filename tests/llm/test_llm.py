"""The text operators against brute force, on a fixture with nulls, empty and long texts, ties, copies and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("netmetrics.llm")

from netmetrics.llm import common as c  # noqa: E402
from netmetrics.llm import decontamination, jaccard, langid, line_dedup, packing, quality, secrets, substring_dedup, tokens, toxicity  # noqa: E402

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, tag int, b string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def texts():
    rng = random.Random(4)
    words = ["stone", "River", "élan", "moon", "tree", "glass", "cloud", "wind", "Salt", "fire", "bird", "of", "the", "in", "ß", "x1"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    base, passage = text(120), text(60)
    out = [None, "", " \n\t\n", "..., !!", "One two", "one TWO", "one two", text(40), base, base, base + " tail", base.replace("moon", "sun", 1)]
    out += [text(30) + " " + passage + " " + text(30) for _ in range(6)] + [passage, passage.upper()]
    out += ["\n".join([text(8), "A shared LINE of text ", text(5), "short", "a shared line of text"]) for _ in range(5)]
    out += ["x" * 5000, "ab " * 4000, text(3000), "日本語 " * 40, 'password = "hunter22hunter" AKIA' + "A1" * 9 + " " + "0f" * 20, "token: abc; secret=token: abcdefgh", "# $ % & | < > " * 5]
    out += [" ".join(base.split()[k:] + [f"n{k}"]) for k in range(1, 12)]
    return out


@pytest.fixture(scope="module")
def rows():
    return dict(enumerate(texts()))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", None, 1, 2, "c") for k, t in rows.items()], SCHEMA).repartition(3)


def by_id(df, skip=1):
    return {r[0]: tuple(r)[skip:] for r in df.collect()}


def test_decontamination(spark, rows, docs):
    item = [(1, rows[18][: len(rows[18]) // 2]), (1, rows[18]), (2, "One two"), (3, None), (4, "!!"), (None, "River"), (10, "nowhere to be found at all")]
    bench = spark.createDataFrame(item, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in item:
        w = word.findall((t or "").translate(AZ))
        for k in range(max(1, len(w) - 9)):
            if w and i is not None:
                windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = {}
    for d, t in rows.items():
        w, hit, items = word.findall((t or "").translate(AZ)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[tuple(w[k : k + n])]
        want[d] = (len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit))
    for block in (1 << 20, 10):  # one block of queries, and several
        assert {k: v[:5] for k, v in by_id(decontamination.contamination(docs, bench, block=block)).items()} == want
        kept = decontamination.remove_contaminated(docs, bench, block=block)
        assert {r["doc_id"] for r in kept.collect()} == {d for d, x in want.items() if not x[4]} and kept.columns == docs.columns
    places = decontamination.matches(docs, bench).collect()  # of each suffix its longest match only, so not all that are hit
    assert {r["doc_id"] for r in places} <= {d for d, x in want.items() if x[4]}
    assert max(r["n_words"] for r in places if r["item_id"] == "1") == len(word.findall(rows[18]))
    assert not any(r["contaminated"] for r in decontamination.contamination(docs, bench.limit(0)).collect())


def test_benchmark_of_several_blocks(spark, odd):
    texts = [r["text"] for r in odd.collect() if r["text"]]
    bench = spark.createDataFrame([(k, " ".join(t.split()[:12])) for k, t in enumerate(texts)] + [(None, texts[0]), (99, None)], "item_id long, text string")
    one, several = (sorted(map(tuple, decontamination.contamination(odd, bench, block=n).collect()), key=str) for n in (1 << 20, 10))
    assert one == several and len(one) == odd.count() and any(x[5] for x in one)
    a, b = (sorted(map(str, decontamination.remove_contaminated(odd, bench, block=n).collect())) for n in (1 << 20, 10))
    assert a == b and len(a) < len(one)
    rows = list(decontamination.query_blocks(bench, 10))
    assert len(rows) > 2 and all(sum(len(t or "") for _, t in x[:-1]) < 10 for x in rows)  # the driver holds one at a time
    assert list(decontamination.query_blocks(bench.limit(0), 10)) == [[]]


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path()).encode(text, add_special_tokens=False).ids


def test_token_counts(rows, docs, monkeypatch):
    want = {d: (len((t or "").encode()), n := len(ids_of(t or "")), n > 1024) for d, t in rows.items()}
    assert by_id(tokens.token_counts(docs)) == want
    monkeypatch.setattr(tokens, "BLOCK", 2000)
    assert by_id(tokens.token_counts(docs)) == want  # several blocks of a vocabulary
    monkeypatch.setattr(tokens, "VOCABULARY", 50)
    assert by_id(tokens.token_counts(docs)) == want  # several vocabularies of a task
    batches = docs.select("doc_id", "text").coalesce(1).toArrow().to_batches()
    monkeypatch.setattr(tokens, "VOCABULARY", 200_000)
    made = [r for b in tokens._blocks(tokens.default_path(), 16)(iter(batches)) for r in b.to_pylist()]
    assert sum(r["fragment"] >= 0 for r in made) <= 16 and sum(r["fragment"] == tokens.MATRIX for r in made) > 1  # rows go by tasks, not by blocks
    s, p = tokens.Splitter(tokens.default_path()), tokens.Pieces(tokens.default_path())
    for t in ["a<|endoftext|>b \n\n x", "I'm  don't\t\t ", "á \U0001f600 ١٢ ²½ \x85\x1c", "  x y"]:
        assert [i for x in s(t) for i in p(x)] == ids_of(t)


def brute_substrings(rows):
    seen, out = set(), {}
    for d in sorted(rows):
        raw = (rows[d] or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[d] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), sha(kept))
    return out


@pytest.mark.parametrize("bucket", [3000, 1])
def test_substring_dedup(rows, docs, bucket, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET", bucket)
    assert by_id(substring_dedup.substring_report(docs)) == brute_substrings(rows)


def test_interval_tree():
    # suffixes of a group: common prefixes 5, 7, 5; the byte before differs only in the inner interval
    assert sorted(substring_dedup.interval_tree([0, 5, 7, 5], [1, 1, 2, 1], 4)) == [(5, 0, 3), (7, 1, 2)]
    assert list(substring_dedup.interval_tree([0, 5], [1, 1], 4)) == []


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(AZ)
    first, out = {}, {}
    for d in sorted(rows):
        for x in {key(x) for x in (rows[d] or "").split("\n")}:
            if len(x) >= 10:
                first.setdefault(x, d)
    for d, t in rows.items():
        lines = (t or "").split("\n")
        out[d] = [x for x in lines if first.get(key(x), d) == d], len(lines)
    return out


def test_line_dedup(rows, docs):
    brute = brute_lines(rows)
    assert by_id(line_dedup.line_dedup_report(docs)) == {d: (n, n - len(k), sha("\n".join(k))) for d, (k, n) in brute.items()}
    new = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.line_dedup(docs).collect()}
    assert {d: x[0] or "" for d, x in new.items()} == {d: "\n".join(k) for d, (k, _) in brute.items()}
    assert new[20][1] == len(new[20][0])


def test_line_runs_compact(spark):
    store = line_dedup.LineRuns(spark, fan_in=2)
    for k in range(5):
        found = store.ingest(spark.createDataFrame([(k, 1, 1), (k, 2, k)], "k long, h1 long, h2 long"))
        assert sorted(map(tuple, found.collect())) == ([] if k == 0 else [(k, 1, 1)])
    assert len(store.runs()) == 2 and len(store.levels) == 3
    store.close()


def brute_quality(t):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    word, t = re.compile(r"[^\x20\x09-\x0D]+"), t or ""
    w, seen, lines, line_chars = word.findall(t), set(), 0, 0

    def inside(n):
        grams = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        often = {g for g, m in Counter(grams).items() if m > 1}
        return {k + j for k, g in enumerate(grams) if g in often for j in range(n)}

    for x in t.split("\n"):
        if x in seen and word.search(x):
            lines += 1
            line_chars += sum(map(len, word.findall(x)))
        seen.add(x)
    chars = sum(map(len, w))
    failed = len(w) < 20 or 100 * len(inside(8)) > 30 * len(w)
    bad = 100 * line_chars > 40 * chars or any(100 * sum(len(w[k]) for k in inside(n)) > limit * chars for n, limit in ((5, 50), (8, 35), (12, 30)))
    return len(w), chars, len(re.findall(r"[#*$%&|<>]", t)), lines, len(inside(8)), failed, not failed and not bad


def test_quality(rows, docs):
    got = by_id(quality.quality(docs))
    assert {d: x[:7] for d, x in got.items()} == {d: brute_quality(t) for d, t in rows.items()}
    kept = quality.keep_quality(docs)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, x in got.items() if x[6]} and kept.columns == docs.columns


def test_quality_verdicts(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"w{rng.random():.9f}" for _ in range(n))
    one, line = fresh(10), fresh(3)
    texts = {k: " ".join(part for _ in range(2) for part in (one, fresh(m))) for k, m in enumerate(range(0, 60, 3))}
    texts |= {100 + m: "\n".join([line] * m + [fresh(30)]) for m in range(1, 20)}
    phrase = fresh(6)
    texts |= {200 + m: " ".join(part for _ in range(6) for part in (phrase, fresh(m))) for m in range(1, 12)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {d: brute_quality(t) for d, t in texts.items()}
    assert {d: x[:7] for d, x in by_id(quality.quality(df)).items()} == want
    assert {x[5:] for x in want.values()} == {(True, False), (False, False), (False, True)}


def brute_pieces(rows):
    out = {}
    for d, t in rows.items():
        ids, at, piece = [*ids_of(t or ""), 0], 0, 0
        while at < len(ids):
            n = len(ids) % 2048 if at == 0 and len(ids) % 2048 else 2048
            out[d, piece] = (at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()))
            at, piece = at + n, piece + 1
    return out


def check_packed(got, want):
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    seq = {}
    for r in got:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in seq.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048
    return len(seq)


def test_packing(rows, docs):
    want = brute_pieces(rows)
    n = check_packed(packing.pack(docs).collect(), want)
    assert n <= 1 + -(-sum(x[1] for x in want.values()) // 2048)


@pytest.mark.parametrize("lengths", [[1], [2048] * 3, [700] * 10, list(range(1, 2049)), [1025] * 7 + [1] * 5])
def test_plan(lengths):
    h = np.bincount(lengths, minlength=2049)
    runs = packing.plan(h)
    used = np.zeros(2049, int)
    for slots, n in runs:
        assert sum(x for x, _ in slots) <= 2048
        for x, _ in slots:
            used[x] += n
    assert (used == h).all() and sum(n for _, n in runs) <= 1.25 * sum(lengths) / 2048 + sum(x > 1024 for x in lengths) + 1 + len(lengths) // 2


def test_plan_rounds_within_groups():
    rng = np.random.default_rng(1)
    lengths = np.minimum(2048, np.exp(rng.normal(6.3, 0.9, 20000)).astype(int) + 1)
    h = np.bincount(lengths, minlength=2049)
    large = np.where(np.arange(2049) < 2048, h, 0)
    cut = packing.groups(large, packing.SMALL, packing.GROUPS)
    assert len(cut) == packing.GROUPS and sum(len(g) > 1 for g in cut) > 60  # several lengths count as the largest of them
    each = [sum(h[x] for x in g) for g in cut]
    assert max(each) < 2 * sum(each) / len(each) and sorted(x for g in cut for x in g) == [x for x in range(65, 2048) if h[x]]
    runs = packing.plan(h)
    assert len(runs) < 3 * 2048 and sum(n for _, n in runs) <= 1.01 * lengths.sum() / 2048
    assert packing.fullest([900, 500, 300], [1, 1, 9], 2048) == [0, 1, 2, 2] and packing.fullest([900, 500, 300], [0, 3, 1], 2048, 600) == [1, 1, 1]


def test_secrets(spark, rows, docs):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = {}
    for d, t in rows.items():
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t or "") if len(m[1]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in sorted(found))
        want[d] = (*(sum(x[1] == k for x in found) for k in range(3)), sha(text))
    assert {d: x[:4] for d, x in by_id(secrets.secret_report(docs)).items()} == want
    # a second scan of the same blobs scans nothing, and finds the same
    found, ledger = secrets.secrets(docs)
    assert secrets.scan_new(docs, "doc_id", "text", ledger).count() == 0
    assert secrets.scan_new(docs, "doc_id", "text", ledger, secrets.BASE).count() == len({t or "" for t in rows.values()})
    assert sorted(map(repr, secrets.secrets(docs, ledger=ledger)[0].collect())) == sorted(map(repr, found.collect()))


def brute_components(rows):
    sets = {d: jaccard.word_set(t or "") for d, t in rows.items()}
    comp = {d: d for d in rows}
    for a in rows:
        for b in rows:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((comp[a], comp[b]))
                comp = {d: x if v == y else v for d, v in comp.items()}
    return {d: (len(sets[d]), comp[d]) for d in rows}


def test_jaccard(rows, docs):
    want = brute_components(rows)
    assert by_id(jaccard.near_duplicates(docs)) == want
    kept = jaccard.drop_near_duplicates(docs)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, x in want.items() if d == x[1]} and kept.columns == docs.columns


@pytest.mark.parametrize(("short", "few", "turns", "split"), [(12, 48, 2, 1024), (2, 1, 1, 7), (2, 0, 0, 5)])
def test_jaccard_long_lists(spark, short, few, turns, split, monkeypatch):
    for name, x in (("SMALL_LIST", short), ("FEW", few), ("TURNS", turns), ("SPLIT", split)):
        monkeypatch.setattr(jaccard, name, x)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    noisy = lambda words, share: " ".join(w if rng.random() > share else f"n{rng.random()}" for w in words)
    rows = {d: noisy(base, 0.025) for d in range(60)}
    rows |= {100 + d: noisy(base[:40] + [f"{d % 4}x{k}" for k in range(60)], 0.02) for d in range(40)}  # groups that share a passage
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = brute_components(rows)
    assert by_id(jaccard.near_duplicates(df)) == want and len({x[1] for x in want.values()}) > 5


def test_fragments_are_cuts_of_the_order():
    level = np.random.default_rng(2).integers(0, 60, 1 << jaccard.SKETCH).astype(np.uint8)
    cuts = jaccard.order_cuts(level, 16)
    g = np.random.default_rng(3).integers(0, 2**63, 100_000).astype(np.uint64) << np.uint64(1)
    own = level[(g >> np.uint64(64 - jaccard.SKETCH)).astype(np.int64)]
    to = np.searchsorted(cuts, jaccard.order_key(g, own), "right")
    order = np.lexsort((g, own))
    assert (np.diff(to[order]) >= 0).all() and len(np.unique(to)) == 16


def test_language_and_toxicity():
    rng = random.Random(1)
    words = {"aa": ["bada", "dodo", "gabo"], "zz": ["xiti", "kesi", "tixe"]}
    made = [(" ".join(rng.choice(words[x]) + rng.choice(words[x]) for _ in range(12)), x) for x in words for _ in range(60)]
    m = langid.train(made[::2])
    for t, x in made[1::2]:
        k, score = langid.predict(*c.utf8(__import__("pyarrow").array([t])), m)
        assert m.languages[k[0]] == x and 0 <= score[0] <= 1
    plain = [" ".join(rng.choice("stone river moon tree glass cloud wind salt fire bird".split()) for _ in range(30)) for _ in range(200)]
    rude = [t.replace("moon", "you wretched grubbler", 2) for t in plain[:100] if "moon" in t]
    model = toxicity.train([(t, 0) for t in plain[100:]] + [(t, 1) for t in rude])
    tool = toxicity.Compressors(model)
    score = lambda t: toxicity.describe(tool.saved(toxicity.normal(t))) @ model.weights + model.bias
    assert np.mean([score(t) > 0 for t in rude]) > 0.9 and np.mean([score(t) > 0 for t in plain]) < 0.1


def test_learned_queries(spark, docs):
    m = langid.fitted(docs)
    got = by_id(langid.identify(docs, m))
    assert got[0][1] == got[1][1] == got[3][1] == "und" and got[8][1] == "en"
    none = toxicity.fitted(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["score"] == 0 and r["predicted"] == 0 for r in toxicity.score(docs, none).collect())


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"word{k}" for k in range(60))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (7, "other " + text), (7, "some more words here\n" + text)], "doc_id long, text string")
    assert sorted((r[0] or -1, r[2]) for r in substring_dedup.substring_report(df).collect()) == [(-1, 0), (5, len(text)), (5, len(text)), (7, len(text)), (7, len(text))]
    assert {(r[0], r[2]) for r in jaccard.near_duplicates(df).collect()} == {(None, None), (5, None), (7, None)}
    assert sorted((r[0] or -1, r[2]) for r in line_dedup.line_dedup_report(df).collect()) == [(-1, 0), (5, 1), (5, 1), (7, 0), (7, 1)]
    assert tokens.token_counts(df).count() == packing.pack(df).where("piece = 0").count() == secrets.secret_report(df).count() == 5


def test_empty_tables(spark, docs):
    none, bench = docs.limit(0), spark.createDataFrame([], "item_id long, text string")
    for df in (decontamination.contamination(none, bench), tokens.token_counts(none), substring_dedup.substring_report(none), line_dedup.line_dedup_report(none), quality.quality(none), packing.pack(none), secrets.secret_report(none), jaccard.near_duplicates(none)):
        assert df.count() == 0


def test_pipeline(spark, rows, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[18])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r["doc_id"]: rows[r["doc_id"]] for r in quality.quality(docs).where("kept").collect()}
    left = {d: "\n".join(k) for d, (k, _) in brute_lines(left).items()}
    left = {d: left[d] for d, x in brute_components(left).items() if d == x[1]}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall(rows[18].translate(AZ))
    windows = {" " + " ".join(w[k : k + 10]) + " " for k in range(len(w) - 9)}
    left = {d: t for d, t in left.items() if not any(x in " " + " ".join(word.findall(t.translate(AZ))) + " " for x in windows)}
    check_packed(pipeline.run(spark, f"file://{tmp_path}").collect(), brute_pieces(left))


def test_parity_bitmaps_bound_overlaps():
    rng = random.Random(4)
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(w if rng.random() > d % 9 / 100 else f"n{rng.random()}" for w in base[: 100 + 40 * (d % 8)]) for d in range(40)]
    out = next(jaccard._bits(iter([jaccard.pa.RecordBatch.from_pydict({"k": list(range(40)), "text": texts})])))
    bits = np.frombuffer(b"".join(out.column("bits").to_pylist()), np.uint64).reshape(40, -1)
    sets = [jaccard.word_set(t) for t in texts]
    for a in range(40):
        for b in range(a):
            assert int(np.bitwise_count(bits[a] ^ bits[b]).sum()) <= len(sets[a] ^ sets[b])


def test_jaccard_repeated_id_with_other_text(spark):
    x, y = (" ".join(f"{p}{k}" for k in range(80)) for p in "xy")
    df = spark.createDataFrame([(5, x), (5, y), (7, x + " end"), (9, y + " end"), (11, "alone here")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (11, 11)}


def test_toxicity_of_a_long_tail():
    rng = random.Random(2)
    plain, bad = ([f"{kind}{k * 7919 % 1000003:06d}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(1, n)] for kind, n in (("s", 300), ("zq", 101)))
    text = [[rng.choice(plain) for _ in range(rng.randint(20, 80))] for _ in range(4000)]
    for w in bad:  # each in 3 % of the toxic rows of training and of test
        for part in (range(0, 1000), range(1000, 2000)):
            for d in rng.sample(part, 30):
                text[d][rng.randrange(len(text[d]))] = w
    rows = [(" ".join(t), int(d < 2000)) for d, t in enumerate(text)]
    model = toxicity.train(rows[:1000] + rows[2000:3000])
    tool = toxicity.Compressors(model)
    found = lambda part: np.mean([toxicity.describe(tool.saved(toxicity.normal(t))) @ model.weights + model.bias > 0 for t, _ in part])
    assert found(rows[1000:2000]) > 0.8 and found(rows[3000:]) < 0.1


def test_versions_of_one_path(spark):
    rows = [(7, f"version {k} token = {'z' * (6 + k)}") for k in range(2000)] + [(None, "token = abcdefgh")] * 2 + [(8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    new = secrets.scan_new(df, "doc_id", "text")
    assert new.count() == 2002
    joined = [x for x in new._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join LeftSemi" in x]
    assert len(joined) == 1 and re.search(r"\(\(k#.* AND \(blob#", joined[0])
    found, ledger = secrets.secrets(df)
    assert found.count() == len(rows) and ledger.count() == 2002
    assert {len(r["spans"]) for r in found.where("doc_id = 7").collect()} == {1}


def test_many_secrets_in_a_text(spark):
    text = "x ".join(f"token = abc{k:05d} " for k in range(700))
    got = secrets.secret_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = [(m.start(), m.end()) for m in re.finditer(r"token = abc\d{5}", text)]
    assert got["n_assign"] == 700 and got["spans"].split(",") == [f"assign:{a}:{z}" for a, z in want]


CLASHES = "doc_id long, text string, k long, _k long, _drop string, drop int, _gone string, gone boolean, tag int, size double, part int, blob string"


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Rows with a null id, repeated rows, an id with two texts, and columns that operators could use for themselves."""
    base = [(d, t) for d, t in rows.items() if d not in (26,)] + [(None, rows[8]), (None, None), (9, rows[9]), (9, rows[20]), (8, rows[8])]
    return spark.createDataFrame([(d, t, 10 + k, 20 + k, f"d{k}", k, f"g{k}", k % 2 == 0, k, k / 2, k, f"b{k}") for k, (d, t) in enumerate(base)], CLASHES)


def other_columns(df):
    return sorted(tuple(r)[2:] for r in df.collect())


def test_columns_of_clashing_names_survive(spark, odd):
    bench = spark.createDataFrame([(1, "nowhere to be found")], "item_id long, text string")
    all_rows = {x[0]: x for x in other_columns(odd)}
    for df in (line_dedup.line_dedup(odd), jaccard.drop_near_duplicates(odd), quality.keep_quality(odd), decontamination.remove_contaminated(odd, bench)):
        assert df.columns == odd.columns
        got = other_columns(df)
        assert got and all(all_rows[x[0]] == x for x in got) and len(got) == len({x[0] for x in got})
    assert len(other_columns(line_dedup.line_dedup(odd))) == len(all_rows)


def test_every_row_has_a_result(spark, odd):
    n, bench = odd.count(), spark.createDataFrame([(1, "one two")], "item_id long, text string")
    m, t = langid.fitted(odd.selectExpr("*", "'en' AS lang")), toxicity.train([("you idiot there", 1), ("a fine day", 0)] * 20)
    reports = {
        1: decontamination.contamination(odd, bench), 2: tokens.token_counts(odd), 3: substring_dedup.substring_report(odd), 4: line_dedup.line_dedup_report(odd), 5: langid.identify(odd, m),
        6: quality.quality(odd), 7: packing.pack(odd).where("piece = 0"), 8: secrets.secret_report(odd), 9: toxicity.score(odd, t), 10: jaccard.near_duplicates(odd),
    }
    ids = sorted((r[0] is None, r[0]) for r in odd.select("doc_id").collect() if r[0] is not None)
    for k, df in reports.items():
        got = [r[0] for r in df.select("doc_id").collect()]
        assert len(got) == n and got.count(None) == 2 and sorted((False, x) for x in got if x is not None) == ids, k
    for k in (5, 9):
        got = reports[k].collect()
        assert all(0 <= r["score"] <= 1 for r in got) and all(r["held_out"] for r in got if r["doc_id"] is None)
        assert len({(r["score"],) for r in got if r["doc_id"] in (0, 1)}) == 1  # null and empty texts alike
        assert len({r["score"] for r in got if r["doc_id"] == 8}) == 1  # repeated rows alike


def test_learned_operators_on_empty_tables(spark, docs):
    none = docs.limit(0)
    m, t = langid.fitted(none), toxicity.fitted(none, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert m.languages == [] and langid.identify(none, m).count() == toxicity.score(none, t).count() == 0
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(docs, m).collect()} == {("und", 0.0)}


def test_samples_are_bounded_for_each_value(spark):
    from netmetrics.llm.sampling import bounded, piece

    df = spark.range(20000).selectExpr("id AS doc_id", "CASE WHEN id < 30 THEN 'rare' ELSE 'often' END AS lang", "id AS size")
    got = {r[0]: r[1] for r in bounded(df, 500, "lang").groupBy("lang").count().collect()}
    assert got["rare"] == 30 and 400 < got["often"] < 600 and bounded(df, 500, "lang").columns == df.columns
    text = "".join(chr(97 + k % 26) for k in range(1000))
    got = [r[0] for r in spark.range(50).selectExpr("id AS doc_id", f"'{text}' AS text").select(piece("text", 100)).collect()]
    assert all(len(x) == 100 and x in text for x in got) and len(set(got)) > 10


def test_components_settle_or_raise(spark, tmp_path, monkeypatch):
    from netmetrics.llm import components as cc

    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r["component"] for r in cc.components(path, f"file://{tmp_path}", "x").collect()} == {0}
    monkeypatch.setattr(cc, "MOST_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="not settled"):
        cc.components(path, f"file://{tmp_path}", "y")


def test_longest_match_is_each_documents_own(spark):
    w = [f"w{k}" for k in range(60)]
    df = spark.createDataFrame([(1, " ".join(w[:12])), (2, " ".join(w[:40])), (3, " ".join(w[20:33]) + " x " + " ".join(w[5:16])), (4, "w1 w2")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    assert {r["doc_id"]: r["longest_match"] for r in decontamination.contamination(df, bench).collect()} == {1: 12, 2: 40, 3: 13, 4: 0}
    for block in (1 << 20, 10):
        places = {(r["doc_id"], r["item_word"], r["doc_word"], r["n_words"]) for r in decontamination.matches(df, bench, block=block).collect()}
        assert (2, 0, 0, 40) in places
