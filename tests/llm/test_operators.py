"""The operators against brute force and exact round trips, on rows with nulls, ties, empty and long texts."""

import base64
import collections
import hashlib
import random
import weakref
import zlib

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import ann, bpe, chat, common, components, jaccard, line_dedup, packing, passages, quality, toxicity, url_trust

DOCS = "doc_id long, text string, __n string"
LINE = "a line that more than two documents hold"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    out = [None, "", "   \n\t", "one", "ONE", "é ß \U0001f600 's 12", "x" * 20000]
    for k in range(8):
        own = list(base)
        for _ in range(k // 2):
            own[rng.randrange(120)] = "changed"
        out.append(" ".join(own))
    for k in range(6):
        out.append(f"own {k}\n {LINE.upper() if k % 2 else LINE}\t\n" + " ".join(rng.choice(words) for _ in range(30)))
    out.append("same words again and " * 60)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x")], DOCS)


def test_lines(spark, docs, texts):
    lines = {i: (t or "").split("\n") for i, t in enumerate(texts)}
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, ls in lines.items():
        for x in ls:
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    got = {r["doc_id"]: r for r in line_dedup.digest(docs).collect()}
    for i, ls in lines.items():
        stay = [x for x in ls if len(held[key(x)]) < 3 or max(held[key(x)]) == i]
        assert (got[i]["n_lines"], got[i]["n_dropped"]) == (len(ls), len(ls) - len(stay))
        assert got[i]["kept_sha256"] == hashlib.sha256("\n".join(stay).encode()).hexdigest()
    assert got[None]["n_dropped"] == 0
    assert line_dedup.line_dedup(docs).columns[:3] == docs.columns
    assert line_dedup.digest(docs.limit(0)).count() == 0


def test_lines_are_joined_alike_at_any_size(spark):
    few = spark.createDataFrame([(i, f"own {i}\n{LINE}") for i in range(4)], "doc_id long, text string")
    got = line_dedup.line_dedup(few)
    assert sorted((r["doc_id"], r["text"], r["__n_dropped"]) for r in got.collect()) == [(i, f"own {i}" + f"\n{LINE}" * (i == 3), int(i < 3)) for i in range(4)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()  # few positions go the way that many go


def test_suffix_repeats():
    rng = random.Random(2)
    for _ in range(60):
        b = np.array([rng.randrange(rng.choice([1, 2, 26])) for _ in range(rng.randint(0, 90))], np.uint8)
        cover, longest = np.zeros(len(b), bool), 0
        for i in range(len(b)):
            for j in range(i + 1, len(b)):
                n = 0
                while j + n < len(b) and b[i + n] == b[j + n]:
                    n += 1
                if n >= 9:
                    cover[i : i + n] = cover[j : j + n] = True
                    longest = max(longest, n)
        assert quality.suffix_repeats(b, 9) == (cover.sum(), longest)


def test_quality(docs, texts):
    import re

    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        many = collections.Counter(windows)
        twice = {k + j for k, w in enumerate(windows) if many[w] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(twice), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(twice) > 50 * len(words))
        assert r["kept"] <= (not r["base_failed"])
    assert not got[len(texts) - 1]["kept"]


def test_urls(spark):
    rows = [
        (1, "http://good.example.net/en/x", '<a href="http://mid.com/a">'), (2, "http://mid.com/", '<a class=b href="//far.com/">'),
        (3, "http://BAD.foo.net/q?x", ""), (4, "http://lone.com", None), (5, None, None), (6, "http://evil.com/z", "<a href='http://bad.foo.net'>"),
        (7, "http://a.example.net/fr", ""), (8, "http://x.org/fr/#a", ""), (9, "http://xnet/", ""), (9, "no url", ""),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_trust.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("good.example.net", "/en/x", "example.net/en/", "allow")
    assert got[3] == ("bad.foo.net", "/q", "net/", "block") and got[6][3] == "block" and got[2][3] == "allow"
    assert got[4] == ("lone.com", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[7][2:] == ("net/", "block") and got[8][2:] == ("org/fr/", "allow")


def test_urls_of_a_hub(spark):
    rows = [(0, "http://hub.net/", ""), (1, "http://good.org/fr/", ""), (2, "http://fine.com/", "")]
    rows += [(10 + k, f"http://l{k}.com/", "<a href='http://hub.net/'>") for k in range(3000)]
    # one host that all of the hub's linkers are linked from: in the second round their parts come together
    rows += [(5000, "http://feeder.com/", "".join(f"<a href='http://l{k}.com/'>" for k in range(3000)))]
    got = {r["page_id"]: r for r in url_trust.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[10 + k]["verdict"] for k in range(3000)} == {"block"}
    assert got[5000]["verdict"] == "block" and got[5000]["distrust"] > 0.1
    assert got[1]["verdict"] == got[2]["verdict"] == "allow"


def test_trust_brute_force(spark):
    """Scores and shares against matrix powers on a random graph."""
    rng = np.random.default_rng(12)
    n = 25
    links = np.where(rng.random((n, n)) < 0.12, rng.integers(1, 4, (n, n)), 0)
    np.fill_diagonal(links, 0)
    seeds = {"trust": [0, 1], "distrust": [2, 3]}
    edges = [(f"h{i}", f"h{j}", int(links[i, j])) for i in range(n) for j in range(n) if links[i, j]]
    rows = [(f"h{i}", kind) for kind, own in seeds.items() for i in own]
    got = {r["host"]: r for r in url_trust.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(rows, "host string, kind string"), tolerance=1e-9, rounds=200).collect()}
    linked = links.sum(0) + links.sum(1) > 0
    for kind, m in (("trust", links), ("distrust", links.T)):
        step = m / np.maximum(m.sum(1, keepdims=True), 1)
        spread = lambda start, step=step: np.linalg.solve(np.eye(n) - 0.85 * step.T, 0.15 * start)
        own = np.isin(np.arange(n), seeds[kind])
        score, every = spread(own.astype(float)), spread(linked.astype(float))
        for i in range(n):
            if linked[i]:
                share = 1.0 if own[i] else min(score[i] / (every[i] - 0.15), 1.0) if every[i] > 0.15 + 1e-12 else 0.0
                assert got[f"h{i}"][kind] == pytest.approx(score[i], abs=1e-7) and got[f"h{i}"][f"{kind}_share"] == pytest.approx(share, abs=1e-6)
    assert all(r["converged"] for r in got.values())
    few = url_trust.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(rows, "host string, kind string"), rounds=1)
    assert not few.first()["converged"]


def test_chats_in_several_parts(spark):
    """Deep conversations over several partitions: positions and ancestors against the turns themselves, without paths."""
    rng = random.Random(13)
    rows = []
    for c in range(40):
        depth = rng.randint(1, 12)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} {rng.randint(0, 1) if t < 8 else c}") for t in range(depth)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    turns, tree = chat.format_chats(df)
    at = {bytes(r["key"]): r for r in tree.collect()}
    assert len(at) == len({tuple(x[1:] for x in rows if x[0] == c and x[1] <= t) for c, t, _, _ in rows})
    by = collections.defaultdict(dict)
    for r in turns.collect():
        by[r["conv_id"]][r["depth"]] = bytes(r["key"])
    for own in by.values():
        before = 0
        for depth in range(len(own)):
            node = at[own[depth]]
            want = {x for d in range(depth) for x in range(at[own[d]]["start"], at[own[d]]["start"] + len(at[own[d]]["tokens"]))}
            assert node["position"] == before == len(want) and want == {x for a in node["ancestors"] for x in range(a["start"], a["end"])}
            before += len(node["tokens"])


ODD = [(1, None), (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "same text of some words that is short " * 3), (5, "same text of some words that is short " * 3), (6, "same text of some words that is short " * 3), (7, "x" * 300_000), (8, "long words " * 40_000), (None, "no id"), (None, None)]
CLASHING = ("__text", "__gone", "__rank", "__lines", "__score", "__lang", "__limit", "__rejected", "__doc", "__spans", "__n_lines", "row", "seq", "at", "Lang", "id", "cuts")


@pytest.fixture(scope="module")
def odd(spark):
    more = ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(i, t, "en", *["kept"] * len(CLASHING)) for i, t in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {more}").repartition(3)


def counted(rows):
    return collections.Counter(r["doc_id"] for r in rows)


def test_odd_rows(spark, odd):
    """Nulls, empty and very long texts, repeated rows and ids, and clashing names in each operator on documents: a row in, a row out, and equal rows alike."""
    want = collections.Counter(i for i, _ in ODD)
    plain = spark.createDataFrame([(i, t) for i, t in ODD], "doc_id long, text string")
    for f in (line_dedup.digest, quality.quality_rules, lambda d: bpe.encode_decode(d, with_ids=False), jaccard.jaccard_join):
        rows = f(odd).collect()
        assert counted(rows) == want and set(rows) == set(f(plain).collect())
        assert f(odd.limit(0)).count() == 0
    pieces = packing.pack(odd, capacity=4096, with_ids=False).collect()
    assert counted([r for r in pieces if r["piece"] == 0]) == want and packing.pack(odd.limit(0)).count() == 0
    assert passages.shared_passages(odd).where("doc_id = rep_doc_id").count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    scored = toxicity.toxicity(odd, model)
    assert counted(scored.collect()) == want and scored.columns[: len(odd.columns)] == odd.columns and toxicity.toxicity(odd.limit(0), model).count() == 0
    with_lang = toxicity.digest(plain.selectExpr("*", "'en' AS lang"), labels.limit(0)).collect()
    assert counted(with_lang) == want and len({r["score"] for r in with_lang}) == 1


def test_odd_rows_in_stages(spark, odd):
    """What a stage keeps has all columns as they were."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, odd, sf).collect()
        assert rows and all(r[c] == "kept" for r in rows for c in CLASHING), name
        assert list(rows[0].asDict()) == odd.columns and {r["doc_id"] for r in rows} >= {1, 2, 3, 4, 7, None}, name
        assert stage(spark, odd.limit(0), sf).count() == 0, name
    packed = corpus_pipeline.pack_sequences(spark, odd, sf).collect()
    assert counted([r for r in packed if r["piece"] == 0]) == collections.Counter(i for i, _ in ODD)


def test_long_texts_of_one_letter():
    """Memory of the suffix array is a fixed number of arrays."""
    import tracemalloc

    b = np.full(1 << 18, 97, np.uint8)
    tracemalloc.start()
    assert quality.suffix_repeats(b) == (len(b), len(b) - 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 * len(b)


def test_template():
    rng = random.Random(3)
    bits = ["<", "s", ">", "/", "[", "INST", "]", "[ROLE:", "\\", "\0", " ", "\n", "</s>", "é"]
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "", "a]b\\", "<s>"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for _ in range(3)]
        assert chat.read_turns("".join("".join(chat.turn_parts(*t)) for t in turns)) == turns


def test_tree(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {min(c, 3 - t)} {t}") for c in range(6) for t in range(4)]
    rows += [(9, None, None, None), (9, 1, "assistant", None), (10, 0, "user", "[INST]"), (10, 0, "user", "[INST]")]
    turns, tree = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    nodes = sorted(tree.collect(), key=lambda r: r["start"])
    at = {bytes(r["path"]): (r["start"], len(r["tokens"])) for r in nodes}
    assert [r["start"] for r in nodes] == [0, *np.cumsum([len(r["tokens"]) for r in nodes]).tolist()[:-1]]
    for r in nodes:
        p = bytes(r["path"])
        want = {x for i in range(chat.STEP, len(p), chat.STEP) for x in range(at[p[:i]][0], sum(at[p[:i]]))}
        assert want == {x for a in r["ancestors"] for x in range(a["start"], a["end"])} and r["position"] == len(want)
    back = {r["conv_id"]: r for r in chat.read_back(turns, tree).collect()}
    for c in {r[0] for r in rows}:
        own = sorted([(t is not None, t or 0, role or "", text or "") for k, t, role, text in rows if k == c])
        assert back[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest()
        loss = "".join(x for *_, r, x in own if r == "assistant")
        assert (back[c]["loss_chars"], back[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_bpe_borders():
    """Two tokens stay apart exactly if merging their joined bytes gives them back."""
    vocab, rng = bpe.vocabulary(public_tokenizers.path(bpe.VOCABULARY)), random.Random(5)
    assert vocab.ordered
    valid = [i for t, i in vocab.ids.items() if vocab.ends[t] == i]
    for k in range(4000):
        a, b = rng.sample(valid, 2) if k % 2 else (rng.randrange(600), rng.randrange(600))
        assert vocab.apart(a, b) == (vocab.merge(vocab.bytes[a] + vocab.bytes[b]) == [a, b])


def test_bpe(docs, texts):
    import tiktoken

    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs).collect()}
    for i, t in enumerate(texts):
        ids = theirs.encode_ordinary(t or "")
        assert list(got[i]["ids"]) == ids and bytes(got[i]["decoded"]) == (t or "").encode()
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    vocab, rng = bpe.vocabulary(public_tokenizers.path(bpe.VOCABULARY)), random.Random(4)
    for _ in range(50):
        data = bytes(rng.choice(b"thean on") for _ in range(40))
        p, at = bpe.Prefixes(vocab, data), rng.randrange(38)
        p.edit(at, 2, b"er")
        assert p.last == bpe.Prefixes(vocab, data[:at] + b"er" + data[at + 2 :]).last and p.ids() == vocab.merge(p.data)


def test_jaccard(docs, texts):
    sets = {}
    for i, t in enumerate(texts):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    least = brute_links(sets, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(docs).collect()}
    assert {i: (len(s), least[i]) for i, s in sets.items()} == {i: v for i, v in got.items() if i is not None}


def brute_links(sets, percent):
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_jaccard_large_tiles(spark):
    """Tiles of more than SMALL sets, over several bands and blocks, cut by batches, with repeated rows and ids."""
    rng = random.Random(31)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(150):
        own = list(base[: rng.randint(60, 120)])
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = f"c{k}"
        rows.append((rng.choice([k, 1000 + k]), " ".join(own), "x"))
    rows += [rows[3], rows[5], (rows[7][0], "another text of the same id that nothing else is like", "x")]
    sets = {}
    for n, (i, t, _) in enumerate(rows):
        w = t.split()
        sets[i, n] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    least = {k: k for k in sets}
    for _ in range(40):
        for a in sets:
            for b in sets:
                if a < b and (a[0] == b[0] or 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])):
                    least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame(rows, DOCS)
    found = [r for r in jaccard.jaccard_join(df, block_rows=20).collect()]
    assert sorted((r["doc_id"], r["n_shingles"]) for r in found) == sorted((i, len(s)) for (i, _), s in sets.items())
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: least[i, n][0] for i, n in sets}
    sent = spark.sparkContext.broadcast(jaccard.levels(jaccard.shingle_counts(df, 4)))
    cut = jaccard.tiles(jaccard.prefixes(df, sent, 4, 85), 85, chunk=10)
    assert cut.where("kind = 4").count() > 150  # large tiles are met
    one = jaccard.shingle_counts(df, 4)
    assert one.sum() == sum(max(len(t.split()) - 3, 0) for _, t, _ in rows)
    assert jaccard.jaccard_join(df.limit(0)).count() == 0


def test_passages(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(70)] + (shared if i < 4 else []) + [word() for _ in range(40)]), "x") for i in range(8)]
    df = spark.createDataFrame([*rows, (20, None, "x"), (21, "", "x"), (None, " ".join(shared), "x")], DOCS)
    found = passages.shared_passages(df).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"], r["rep_doc_id"]) for r in found if r["rep_doc_id"] == 0} >= {(i, 70, 130, 0) for i in (1, 2, 3)}
    assert {r["doc_id"] for r in found} == {1, 2, 3}
    left = {r["doc_id"]: r["text"] for r in passages.drop_passages(df).collect()}
    assert left[0] == rows[0][1] and left[7] == rows[7][1] and left[20] is None
    assert left[2].split() == rows[2][1].split()[:70] + rows[2][1].split()[130:]


def test_passages_in_another_order():
    rng = np.random.default_rng(6)
    p1, p2, lead = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (60, 60, 30))
    found = passages.passages(np.concatenate([p1, p2]), np.concatenate([p2, p1]), 5, 50, 0.8)
    assert {(r[0], r[2]) for r in found if r[5] == 1.0} >= {(0, 60), (60, 0)}
    # half of the passage's shingles come in another place first
    found = passages.passages(np.concatenate([lead, p1[:30]]), np.concatenate([lead[::-1], p2, lead, p1[:30]]), 5, 50, 0.8)
    assert (0, 64, 90, 154) in {r[:4] for r in found}


def test_passages_beside_a_template():
    rng = random.Random(9)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    template, tails = word(30), [word(30) for _ in range(3)]
    changed = [*tails[2][:15], "changed", *tails[2][16:]]
    # 0, 3: tail 0; 1, 5: tail 1, neither first nor neighbours; 2, 7: tail 2 with a changed word; 4 and 6: the template alone
    tail = {0: tails[0], 1: tails[1], 2: tails[2], 3: tails[0], 4: word(30), 5: tails[1], 6: word(30), 7: changed}
    rows = [word(50) + template + tail[i] + word(50) for i in range(8)]
    sh, soffs = passages.Words(np.frombuffer(b"".join((" ".join(r) + " ").encode() for r in rows), np.uint8), np.cumsum([0, *[len(" ".join(r)) + 1 for r in rows]]), lower=True).shingles(5)
    assert len(set(np.diff(soffs))) == 1
    c = soffs[:-1] + 60  # one shingle of the template
    near = np.zeros(8, np.uint64)
    for k, step in enumerate([*range(-passages.BESIDE, 0), *range(1, passages.BESIDE + 1)]):
        near |= (sh[c + 5 * step] >> np.uint64(61)) << np.uint64(3 * k)
    later, earlier, lead, lone = passages.group_links(np.zeros(8, np.uint64), near)
    assert {(3, 0), (5, 1), (7, 2)} <= set(zip(later.tolist(), earlier.tolist(), strict=True))
    assert lead.all() and not lone[[3, 5]].any() and lone[[0, 1, 2, 4, 6]].all()


def common_runs(a, b, least):
    """(start here, start there, words) of all longest runs of at least least words that two texts share."""
    out, before = [], {}
    for i, x in enumerate(a):
        now = {j: before.get(j - 1, 0) + 1 for j, y in enumerate(b) if x == y}
        out += [(i - n, j - 1 - n + 1, n) for j, n in ((j + 1, n) for j, n in before.items()) if n >= least and j not in now]
        before = now
    return out + [(len(a) - n, j - n + 1, n) for j, n in before.items() if n >= least]


def test_passages_brute_force(spark):
    """Every run of 50 words that two documents share lies in passages found in both, and these are of one class; nothing else is found."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    word = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [word(n) for n in (50, 55, 70, 120)]
    texts = {}
    for i in range(60):
        t = word(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            t += rng.choice(shared) + word(rng.randint(0, 60))
        texts[i * 3 % 61] = t
    texts[70], texts[71], texts[72] = list(texts[5]), list(texts[5]), word(20) + texts[5] + word(20)
    rows = [(i, " ".join(t), "x") for i, t in texts.items()]
    one = passages.shared_passages(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()
    rng.shuffle(rows)
    assert set(one) == set(passages.shared_passages(spark.createDataFrame(rows, DOCS).repartition(7)).collect())  # whatever the layout
    first = {(r["doc"], r["start"], r["end"]): r["first"] for r in passages.classes(spark.createDataFrame(one)).collect()}
    inside = collections.defaultdict(lambda: collections.defaultdict(set))
    for (doc, start, end), f in first.items():
        for k in range(start, end):
            inside[doc][k].add(f)
    for i in texts:
        for j in texts:
            for a, b, n in common_runs(texts[i], texts[j], 50) if i < j else ():
                assert all(inside[i][a + k] & inside[j][b + k] for k in range(n)), (i, j, a, b, n)
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    for r in one:
        a, b = shingles(texts[r["doc_id"]][r["start_word"] : r["end_word"]]), shingles(texts[r["rep_doc_id"]][r["rep_start_word"] : r["rep_end_word"]])
        assert r["end_word"] - r["start_word"] >= 50 and len(a & b) >= 0.8 * len(a | b) and r["n_shared"] == len(a & b) and r["rep_doc_id"] < r["doc_id"]
    assert passages.shared_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_passages_of_a_split_group(spark):
    """A min-hash whose group is dealt over tasks and batches."""
    rng = random.Random(22)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, footer = word(60), word(20)
    rows = [(i, " ".join(word(60) + (shared if i % 3 == 0 else footer) + word(60)), "x") for i in range(90)]
    made = passages.windows(spark.createDataFrame(rows, DOCS), 5, 46, 4)
    links = passages.linked(made.repartition(5), hot=8, sampled=1).collect()
    assert set(links) == set(passages.linked(made.repartition(2), hot=8, sampled=1).collect())
    reach = {i: i for i in range(90)}
    for _ in range(6):
        for r in links:
            if r["doc"] % 3 == r["rep"] % 3 == 0:
                reach[r["doc"]] = reach[r["rep"]] = min(reach[r["doc"]], reach[r["rep"]])
    assert all(reach[i] == 0 for i in range(0, 90, 3)) and all(r["rep"] < r["doc"] for r in links)


def test_passages_of_a_large_group(spark):
    rng = random.Random(10)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    template, tails = word(45), [word(10) for _ in range(20)]
    # each tail is in two documents far apart, which are neighbours in no order by id
    docs = [(i, " ".join(word(60) + template + tails[i % 20] + word(60)), "x") for i in range(40)]
    found = passages.shared_passages(spark.createDataFrame(docs, DOCS)).collect()
    assert {(r["doc_id"], r["rep_doc_id"]) for r in found if r["doc_id"] - r["rep_doc_id"] == 20} == {(i + 20, i) for i in range(20)}


def test_passages_in_classes(spark):
    names = "doc_id long, start_word long, end_word long, rep_doc_id long, rep_start_word long, rep_end_word long"
    found = [(10, 70, 130, 5, 20, 80), (10, 69, 130, 7, 30, 91), (12, 0, 60, 10, 70, 130), (10, 125, 200, 3, 0, 75)]
    got = {(r["doc"], r["start"]): r["first"] for r in passages.classes(spark.createDataFrame(found, names)).collect()}
    assert got == {(5, 20): 5, (7, 30): 5, (10, 69): 5, (10, 70): 5, (12, 0): 5, (10, 125): 3, (3, 0): 3}


def test_passages_drop_in_any_order(spark):
    rng = random.Random(11)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = word(60)
    rows = {i: " ".join(word(70) + shared + word(70)) for i in (10, 5, 7, 12, 3, 8, 20, 6)}
    parts = [spark.createDataFrame([(i, rows[i], "x") for i in ids], DOCS).coalesce(1) for ids in ((10, 5, 7, 12), (20, 3), (8, 6))]
    left = passages.drop_passages(parts[0].union(parts[1]).union(parts[2])).collect()
    held = {r["doc_id"] for r in left if " ".join(shared[10:50]) in r["text"]}
    assert held == {3}


def test_windows():
    v = passages.mix(np.arange(200, dtype=np.uint64))
    _, left, c, right = passages.compact_windows(v, np.array([0, 80, 80, 200]), 10)
    for a, b in ((0, 80), (80, 200)):
        for i in range(a, b, 5):
            for j in range(i + 9, b, 7):
                own = [k for k in range(len(c)) if left[k] <= i <= c[k] <= j <= right[k]]
                assert len(own) == 1 and v[i : j + 1].min() == v[c[own[0]]]


def test_toxicity(spark):
    rng = random.Random(6)
    rows = [(i, " ".join([f"w{rng.randrange(300)}" for _ in range(30)] + (["vile"] if i % 3 == 0 else [])), "en") for i in range(600)]
    docs = spark.createDataFrame([*rows, (9000, None, None), (9001, "", "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.digest(docs, labels).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held)
    assert np.mean([got[i]["predicted"] == (i % 3 == 0) for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.digest(docs, labels.limit(0)).count() == 602
    assert np.array_equal(toxicity.fit(docs, labels, sample_words=3000).table, toxicity.fit(docs.repartition(5), labels, sample_words=3000).table)


def test_toxicity_is_trained():
    """From random vectors, training alone tells texts apart that were held out, by pairs of words that mean nothing one by one."""
    rng = np.random.default_rng(14)
    rows = lambda toxic: np.concatenate([rng.integers(0, 300, 20), [1000, 1001] if toxic else rng.choice([[1000, 5], [7, 1001], [1001, 1000]]), rng.integers(0, 300, 20)]).astype(np.int32)
    labels = np.array([i % 2 for i in range(900)])
    texts = [rows(y) for y in labels]
    right = {}
    for epochs in (0, 12):
        m = toxicity.train(texts[:700], labels[:700], [None] * 700, epochs=epochs, prior=False)
        s = m.score(np.concatenate(texts[700:]), np.concatenate([[0], np.cumsum([len(t) for t in texts[700:]])]))
        right[epochs] = np.mean([(a > b) + (a == b) / 2 for a in s[labels[700:] == 1] for b in s[labels[700:] == 0]])
    assert right[12] > 0.9 and right[12] > right[0] + 0.2


def test_toxicity_repeated_ids(spark):
    """An id in very many rows is learnt from once, whatever the order of its rows and labels."""
    rows = [(i, f"calm words number {i}" + " vile" * (i % 3 == 0)) for i in range(60)] + [(7, f"text {k}") for k in range(300)] + [(7, None)]
    marks = [(i, int(i % 3 == 0)) for i in range(60)] + [(7, 1), (7, 0)]
    models = [toxicity.fit(spark.createDataFrame(r, "doc_id long, text string"), spark.createDataFrame(m, "doc_id long, toxic int")) for r, m in ((rows, marks), (rows[::-1], marks[::-1]))]
    assert all(np.array_equal(a, b) for a, b in zip([models[0].table, models[0].out, *models[0].filters], [models[1].table, models[1].out, *models[1].filters], strict=True))


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(900, 16)).astype(np.float32)
    v[500:600] = v[500]
    bad = [(5001, None), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0, None] * 8), (5005, [1.0])]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + bad, "vec_id long, embedding array<float>")
    got, hits = collections.defaultdict(list), 0
    for r in sorted(ann.search(df).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    m = v.astype(float)
    for q in range(0, 900, 100):
        d = np.sqrt(((m - m[q]) ** 2).sum(1))
        best = sorted((d[i], i) for i in range(900) if i != q)[:10]
        hits += len(set(best) & set(got[q]))
        assert all(s == d[i] for s, i in got[q]) and got[q] == sorted(got[q])
    assert hits >= 81 and set(got) == set(range(0, 900, 100))
    assert ann.search(df.limit(0)).count() == 0


def test_neighbours_where_lists_stay_unprobed(spark, monkeypatch):
    """Clustered vectors in many lists: few are probed, recall holds, ties go to smaller ids over blocks, and the exact option finds all."""
    rng = np.random.default_rng(15)
    middle = rng.normal(size=(60, 12)) * 4
    v = (middle[rng.integers(60, size=4000)] + rng.normal(size=(4000, 12))).astype(np.float32)
    v[1:3000:7] = v[1]  # a third as hot copies, ties at every rank
    monkeypatch.setattr(ann, "BLOCK", 150)
    monkeypatch.setattr(ann, "ASKED", 3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(100, v[100].tolist())], "vec_id long, embedding array<float>")
    m = np.concatenate([v, v[100:101]]).astype(float)
    ids = np.append(np.arange(4000), 100)
    c = ann.centres(m[:3000], 40)
    assert ann.share_probed(m[:3000], c, 10, 0.97) < 30
    for exact in (False, True):
        got = collections.defaultdict(list)
        for r in sorted(ann.search(df, exact=exact).collect(), key=lambda r: (r["query_id"], r["rank"])):
            got[r["query_id"]].append((r["score"], r["vec_id"]))
        right = 0
        for q in range(0, 4000, 100):
            d = np.sqrt(((m - m[q]) ** 2).sum(1))
            best = sorted((d[i], ids[i]) for i in range(len(m)) if ids[i] != q)[:10]
            assert len(got[q]) == 10 and (not exact or got[q] == best)
            right += len(set(best) & set(got[q]))
        assert right >= 0.93 * 400


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    t.encode_special_tokens = True
    rows = packing.pack(docs, capacity=512).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in own)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 512
    assert len(by) <= sum(r["length"] for r in rows) / 512 + 2


def best_fit_decreasing(lengths, capacity):
    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
        else:
            n += 1
        gaps.append((min(fits) if fits else capacity) - length)
    return n


@pytest.mark.parametrize("rows_a_task", [10**6, 40])
def test_best_fit(spark, rows_a_task):
    """Each piece once, no gap inside a sequence, and about as few sequences as brute-force best fit makes; with one task to a sweep and with many."""
    rng = random.Random(41)
    kinds = [lambda: rng.randint(1, 256), lambda: min(256, int(rng.lognormvariate(3, 1)) + 1), lambda: rng.choice([200, 200, 5])]
    lengths = [kinds[i % 3]() for i in range(600)]
    df = spark.createDataFrame([(i // 2, n, "x", i) for i, n in enumerate(lengths)], "`row` long, length long, SEQ string, `se q` long")
    out = packing.best_fit(df, 256, rows_a_task)
    assert out.columns == [*df.columns, "sequence_id", "offset"]
    rows, by = out.collect(), collections.defaultdict(list)
    assert sorted((r["se q"], r["length"]) for r in rows) == list(enumerate(lengths))
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        ends = [a + n for a, n in sorted(own)]
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 256
    least = best_fit_decreasing(lengths, 256)
    assert len(by) <= least + (0 if rows_a_task > 600 else 3)
    assert packing.best_fit(df.limit(0), 256).count() == 0


def test_matching():
    plan = packing.matching({0: 3, 2: 2}, {1: 2, 3: 4, 4: 1})
    # range 1 takes range 0's lowest places; range 3 the nearest range's first, then what range 0 has left
    assert plan == [(1, 0, 1, 0, 0), (3, 0, 1, 2, 0), (3, 2, 2, 0, 2)]


@pytest.mark.parametrize("held", [components.HELD, 0])
def test_components(spark, monkeypatch, held):
    rng, names = random.Random(4), []
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    monkeypatch.setattr(components, "HELD", held)
    monkeypatch.setattr(components, "staged", lambda df, name: names.append(name) or common.staged(df, name))
    least = {x: x for link in links if link[0] != link[1] for x in link}
    for _ in least:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    found = components.components(spark.createDataFrame(links, "a long, b long").repartition(4))
    assert {r["node"]: r["component"] for r in found.collect()} == least
    assert (names.count("step") == 1) == bool(held)  # few links take one step


def test_other_operators_clear_caches():
    path, texts = public_tokenizers.path(packing.VOCABULARY), [b"some words"]
    packing.chunk_tokenizer(path).encode(texts[0])
    tokens = weakref.ref(packing.chunk_tokenizer(path))
    held = common.lean(lambda batches: (tokens() is not None for _ in batches))
    assert list(held(texts)) == [False]  # a worker's next task of another kind finds nothing of the tokenizer's
    assert packing.chunk_tokenizer(path).encode(texts[0])


def test_tokens_stay_between_their_own_tasks():
    path = public_tokenizers.path(packing.VOCABULARY)
    packing.chunk_tokenizer(path)
    bpe.encoder(public_tokenizers.path(bpe.VOCABULARY)).encode("some words")
    held = common.lean(lambda batches: ((packing.chunk_tokenizer.cache_info().currsize, bpe.encoder.cache_info().currsize) for _ in batches), packing.chunk_tokenizer)
    assert list(held([0])) == [(1, 0)]
    assert packing.chunk_tokenizer.cache_info().currsize == 1


def test_few_chunks_remembered(spark, docs):
    cols = ("doc_id", "piece", "start", "length", "ids_crc32")
    whole, few = (packing.token_pieces(docs, with_ids=False, **more).select(*cols).collect() for more in ({}, {"keep": 4}))
    assert sorted(map(str, whole)) == sorted(map(str, few)) and whole


def test_staged_and_small_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    t = common.staged(spark.range(50).repartition(3), "rows")
    assert sorted(r["id"] for r in t.collect()) == list(range(50))
    names = [p.name for p in tmp_path.rglob("*") if p.is_file()]
    assert len(names) >= 2 and not [n for n in names if n.endswith(".crc")]  # each would cost a process more
    common.release(t)
    assert not [p for p in tmp_path.rglob("*.parquet")]
    few = common.small(spark, [(1, None), (2, 3)], "a int, b long")
    assert "ExistingRDD" not in few._jdf.queryExecution().toString()  # rows of an RDD start Python workers
    assert [tuple(r) for r in few.orderBy("a").collect()] == [(1, None), (2, 3)] and few.dtypes == [("a", "int"), ("b", "bigint")]
    assert common.small(spark, [], "a long").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = corpus_pipeline.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
    assert {"sequence_id", "offset"} <= set(corpus_pipeline.run(spark, sf).columns)
