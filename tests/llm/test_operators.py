"""The training-data operators against brute force, and on nulls, empty tables, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("terravane.llm.queries")

from pyspark.sql import functions as F

from terravane.llm import decontaminate, exact_dedup, language_id, line_dedup, ngram_join, packing, secrets, token_count, token_files, toxicity

SCHEMA = "doc_id long, text string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
EDGES = [(1, None), (2, ""), (3, "   \n\t "), (4, "x"), (4, "x"), (None, "no id"), (5, LONG), (6, "é" * 50), (7, "one two three four five six")]


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(spark, rows):
    """With columns named like what the operators make."""
    extra = ["n", "h1", "h2", "x", "at", "line", "words", "kept", "n_tokens", "bucket", "component_id", "version", "gone", "key", "d", "v", "yd", "copies", "part", "__version", "__lines", "__removed", "__gone", "__gone_id", "a.b"]
    return docs(spark, rows).select("doc_id", "text", *[F.lit("c").alias(c) for c in extra])


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(links, nodes):
    label = {n: n for n in nodes}
    while True:
        new = dict(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def near_copies(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        rows.append((i, " ".join(w)))
    return rows


def brute_secrets(text):
    rules = [
        ("assign", re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    found = sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(rules) for m in p.finditer(text or "") if ok(m))
    return [f"{name}:{s}:{e}" for s, _, e, name in found]


def test_secrets_against_regular_expressions(spark):
    rng = random.Random(4)
    parts = ["password", "SeCret", "token", "api_key", "apikey", "=", ":", " ", "  ", "'", '"', "abc", "é", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "\n", "|", "f" * 30, "漢", "_", "-", "/+", "a.b"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(2000)] + EDGES + [(9000, "".join(rng.choice(parts) for _ in range(20_000)))]
    got = secrets.scan_secrets(clashing(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((i is None, i or 0, hashlib.sha256(",".join(brute_secrets(t)).encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.base_sha256) for r in got) == want
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got) == sum(len(brute_secrets(t)) for _, t in rows)


def test_added_kinds(spark):
    t = "x ghp_" + "zK" * 18 + " y -----BEGIN RSA PRIVATE KEY----- z xoxb-1234567890-abcdefgh"
    r = secrets.scan_secrets(docs(spark, [(1, t)])).first()
    assert (r.n_github, r.n_pem, r.n_slack) == (1, 1, 1) and r.base_sha256 == hashlib.sha256(b"").hexdigest()


def test_rules_that_one_pass_cannot_decide_are_refused():
    from terravane.llm.automaton import Rule, compile_rules

    for bad in (r"ab*", r"(ab)+"):
        if bad == r"(ab)+":
            with pytest.raises(ValueError):
                compile_rules((Rule("k", bad),))
    with pytest.raises(ValueError):
        compile_rules((Rule("k", r"a*"),))


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts():
    rng = random.Random(3)
    letters = "abcdefghij   \n\n\t\x1c\x85　'sréßñ漢字🙂0123٣½!!!…×÷_<|endoftext|>"
    rows = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(500)]
    return rows + ["a" * 3000, " " * 200 + "x", "<|endoftext|> a<|endoftext|>", "it's we'll'd"] + ["".join(chr(c) for c in range(a, a + 97) if not 0xD800 <= c < 0xE000) for a in range(0, 0x3000, 97)]


def test_token_counts_are_the_library_s(spark):
    rows = [*enumerate(odd_texts(), 100), *EDGES]
    got = token_count.token_counts(clashing(spark, rows)).collect()
    lib = library()
    want = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_merges_against_one_at_a_time():
    merger, _, _ = token_count._load(token_count.public_tokenizers.path("byte_bpe_50k.json"))
    ranks = dict(zip(merger.keys.tolist(), merger.rank.tolist(), strict=True))
    assert merger.shared.any()
    # every pair has its rank, those of shared slots too, and what is no pair has none
    keys = merger.keys
    assert (merger.ranks(keys // merger.size, keys % merger.size) == merger.rank).all()
    other = (keys + 1)[[k + 1 not in ranks for k in keys.tolist()]]
    assert (merger.ranks(other // merger.size, other % merger.size) == token_count.NEVER).all()

    def left(piece):
        ids = merger.bytes[list(piece)].tolist()
        while True:
            each = [ranks.get(a * merger.size + b, token_count.NEVER) for a, b in zip(ids, ids[1:])]  # noqa: B905
            if not each or min(each) == token_count.NEVER:
                return len(ids)
            i = each.index(min(each))
            ids[i : i + 2] = [int(merger.into[each[i]])]

    pieces = [x.encode() for t in odd_texts()[:150] for x in (t, *token_count.pre_tokens(t))] + [b"", b"a", b"a" * 301, b"aab" * 60]
    assert merger.counts(pieces).tolist() == [left(x) for x in pieces]
    assert merger.counts([]).tolist() == []


def test_counting_leaves_no_pre_tokens_in_idle_workers(spark):
    import pyarrow as pa

    rows = spark.range(0, 400, 1, 4).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("word"), (F.col("id") * 7 + k).cast("string")) for k in range(50)]).alias("text"))
    path = token_count.public_tokenizers.path("byte_bpe_50k.json")
    assert token_count.token_counts(rows).agg(F.sum("n_tokens")).first()[0] > 0

    def held(it):
        for _ in it:
            loaded = token_count._load.cache_info().currsize
            memory = token_count._load(path)[2]
            yield pa.RecordBatch.from_arrays([pa.array([loaded]), pa.array([len(memory.late) + len(memory.before)])], ["loaded", "n"])

    found = spark.range(0, 4, 1, 4).mapInArrow(held, "loaded long, n long").collect()
    assert any(r.loaded for r in found) and all(r.n == 0 for r in found)


def test_token_files_round_trip(spark, tmp_path):
    rows = [*enumerate(odd_texts(), 100), *EDGES]
    folder = str(tmp_path / "tokens")
    index = token_files.write_token_files(docs(spark, rows), folder)
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    lib, ids = library(), {}
    for i, t in rows:
        e = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        ids.setdefault(i, []).append((len(e), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in e))))
    at, seen = 0, []
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in ids[r.doc_id]
        at += r.n_tokens
        seen.append(-1 if r.doc_id is None else r.doc_id)
    assert seen == sorted(seen) and len(seen) == len(rows) and at == sum(p["ids"] for p in index)
    read = [token_files.read_part(folder, p["part"], "<u2") for p in index]
    assert sum(len(r[0]) for r in read) == at


def test_exact_dedup_against_grouping(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a b", "ab", " a\tb\n", "abc", "", None, "é x", "éx"])) for i in range(300)] + [(None, "ab"), (7, "zz"), (7, "zz"), (-5, "abc")]
    got = exact_dedup.exact_groups(clashing(spark, rows), salts=4).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    assert len(got) == len(rows)
    for r in got:
        g = next(g for n, g in groups.items() if hashlib.sha256(n.encode()).hexdigest() == r.text_sha256)
        best = min(g)
        assert r.group_size == len(g) and r.keep_id == (None if best[1] else best[2])
        assert not r.kept or r.doc_id == r.keep_id


def test_ngram_components_against_all_pairs(spark):
    for seed in range(3):
        rows = near_copies(seed) + [(100, None), (101, ""), (102, " \n"), (103, "a b"), (104, "A  B"), (None, "a b"), (105, LONG), (106, LONG + " end")]
        s = {i: sets(t) for i, t in rows if i is not None}
        links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])]
        want = components(links, s)
        got = ngram_join.ngram_components(clashing(spark, rows)).collect()
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert all(r.n_shingles == len(s[r.doc_id]) for r in got if r.doc_id is not None)
        assert len(got) == len(rows)


@pytest.mark.parametrize(("at_once", "most"), [(1 << 20, 1), (0, 99)])
def test_connected_components_in_one_task_or_by_stars(spark, monkeypatch, at_once, most):
    """Few links need one table and no rounds; more of them come to the same components."""
    from terravane.llm import components as C
    from terravane.llm.common import Scratch

    monkeypatch.setattr(C, "AT_ONCE", at_once)
    rng = random.Random(26)
    links = [(rng.randrange(-300, 300) * 2**40, rng.randrange(-300, 300) * 2**40) for _ in range(250)] + [(k, k + 1) for k in range(60)] + [(2**62, k) for k in range(1000, 1040)] + [(5000, 5000)]
    nodes = {n for a, b in links for n in (a, b) if a != b}
    want = components([(a, b) for a, b in links if a != b], nodes)
    table = spark.createDataFrame(links, "u long, v long").repartition(5)
    with Scratch(spark, "few") as scratch:
        assert {r.node: r.component for r in C.connected_components(table, scratch).collect()} == want
        assert 1 <= scratch.n <= most
    with Scratch(spark, "none") as scratch:
        assert C.connected_components(table.where("u = 5000"), scratch).count() == 0


def test_ngram_components_of_a_large_family(spark):
    """Near copies that do not all reach the first one: chains have to be found."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(120), rng.randint(0, 5)):
            w[k] = f"z{i}_{k}"
        rows.append((i, " ".join(w)))
    s = {i: sets(t) for i, t in rows}
    want = components([(a, b) for a in s for b in s if a < b and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])], s)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs(spark, rows)).collect()}
    assert got == want


def test_one_of_each_keeps_columns(spark):
    rows = near_copies(5)
    kept = ngram_join.one_of_each(clashing(spark, rows))
    assert kept.columns == clashing(spark, rows).columns
    found = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs(spark, rows)).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in found.values()})


def brute_lines(rows):
    """Numbers of the lines that go, by place of the row."""
    seen, out = [], [set() for _ in rows]
    order = sorted((i is None, i or 0, n, r) for r, (i, t) in enumerate(rows) if t is not None for n in range(t.count("\n") + 1))
    for _, _, n, r in order:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", rows[r][1].split("\n")[n].lower()) if x]
        s = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        if s:
            if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                out[r].add(n)
            seen.append(s)
    return out


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(30)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(pool).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(words)
            lines.append(" ".join(w).upper() if rng.random() < 0.1 else " ".join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, " \n\t\n"), (103, LONG)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(clashing(spark, rows)).collect()}
    for (i, t), gone in zip(rows, brute_lines(rows), strict=True):
        want = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
        assert out[i].text == want and out[i].n_removed == len(gone)


def test_line_keys_are_the_first_tokens_by_length_of_word(spark):
    """Keys without a count of tokens: the necessary ones of a line, longest first words first, also where words or shingles repeat."""
    rng = random.Random(21)
    words = ["x" * rng.randint(1, 9) + f"{i}" for i in range(40)] + ["é" * 5, "w" * 1100, "w" * 1200]
    lines = [[rng.choice(words) for _ in range(rng.randint(1, 60))] for _ in range(120)]
    lines += [["aaa", "b"] * 30, ["a", "a"] * 9, list("abcdefghijklmnopqrstuvwxyz") * 3, ["one"], ["long" * 9, *["b"] * 40]]
    near = [[*w[:-1], "end"] for w in lines]
    table = spark.createDataFrame([(k, w) for k, w in enumerate(lines + near)], "id int, w array<string>")
    keys = {r.id: r["keys"] for r in line_dedup._keys(table, 4, 5).collect()}
    grams = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in lines + near]
    size = lambda t: min(len(t[0].encode()), 1023)
    for k, w in enumerate(lines + near):
        n = len(grams[k])
        most = len(w) - 4 if len(w) > 4 else 1
        need = lambda m: m - -(-4 * m // 5) + 1
        assert min(need(n), n) <= len(keys[k]) <= max(need(most), n if n < most else 0) and keys[k] == sorted(set(keys[k]))
        if len(w) > 4:
            lengths = sorted((size(t) for t in grams[k]), reverse=True)
            assert [1023 - (c >> line_dedup.LOW) for c in keys[k]] == lengths[: len(keys[k])]
    for a in range(len(grams)):
        for b in range(a):
            if 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b]):
                assert set(keys[a]) & set(keys[b])


def test_lines_of_rows_without_or_with_one_id(spark):
    """Thousands of lines share a place in the order but for their texts: of each pair of near copies one goes."""
    rng = random.Random(12)
    pairs = []
    for _ in range(2000):
        w = [f"w{rng.randrange(5000)}" for _ in range(30)]
        pairs.append((" ".join(w), " ".join([*w[:-1], "end"])))
    for same in (None, 7):
        out = line_dedup.dedup_lines(docs(spark, [(same, t) for p in pairs for t in p])).collect()
        left = {r.text for r in out if r.n_removed == 0}
        assert sum(r.n_removed for r in out) == 2000 and all((a in left) != (b in left) for a, b in pairs)


def test_repeated_rows_and_clashing_names_in_lines(spark):
    rows = [(1, "one two three four five six\nnew words"), (1, "one two three four five six\nnew words"), (2, "One two three four five six"), (3, None), (4, "  ")]
    d = clashing(spark, rows)
    out = line_dedup.without_repeated_lines(d)
    assert out.columns == d.columns and {r["__gone"] for r in out.collect()} == {r["__lines"] for r in out.collect()} == {"c"}
    # repeated rows are alike: their lines have the same place, so both keep them; the later row's only line goes, and it with it
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, rows[0][1]), (1, rows[0][1]), (3, ""), (4, "  ")]


def hits(text, items, window=10):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w = norm(text)
    hit, names = set(), set()
    for name, t in items:
        o = norm(t)
        n = min(window, len(o))
        for k in range(len(o) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == o[k : k + n]:
                    hit.update(range(i, i + n))
                    names.add(str(name))
    return len(w), len(hit), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_contamination_against_windows(spark):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(25)] + ["été"]
    text = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))
    items = [(i, text(1, 14) if i % 3 else text(12, 40)) for i in range(12)] + [(50, None), (51, ""), (52, "!!"), (2, "v1, v2; V3"), (99, "Solo")]
    rows = []
    for i in range(80):
        t = text(0, 30)
        if i % 2:
            t += ". " + (rng.choice(items)[1] or "").upper() + ", " + text(0, 5)
        rows.append((i, t))
    rows += EDGES
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for block in (1 << 24, 200):
        got = decontaminate.find_contamination(clashing(spark, rows), bench, block=block).collect()
        want = sorted((i is None, i or 0, *hits(t, items)) for i, t in rows)
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.items_sha256) for r in got) == want
        clean = decontaminate.without_contamination(clashing(spark, rows), bench, block=block)
        assert clean.count() == sum(1 for w in want if not w[3])


def test_best_boundaries_are_best():
    from itertools import combinations

    import numpy as np

    rng = random.Random(0)
    for _ in range(50):
        bins = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 5) for _ in bins]
        sums = [b * c for b, c in zip(bins, counts, strict=True)]
        got = packing.best_boundaries(np.array(bins), np.array(counts), np.array(sums), 3)
        pad = lambda bounds: sum(c * (min(x for x in bounds if x >= b) - b) for b, c in zip(bins, counts, strict=True))
        best = min(pad([*c, bins[-1]]) for k in range(3) for c in combinations(bins[:-1], k))
        assert pad(got) == best and got[-1] == bins[-1] and len(got) <= 3


def brute_packing(rows, buckets, budget):
    """(id, length, bucket, boundary, batch, slot) of each row, all choices of boundaries compared."""
    from itertools import combinations

    rows = [(i, max(n or 0, 0)) for i, n in rows]
    lengths = sorted({n for _, n in rows})
    pad = lambda bounds: sum(min(b for b in bounds if b >= n) - n for _, n in rows)
    bounds = min(([*c, lengths[-1]] for k in range(min(buckets, len(lengths))) for c in combinations(lengths[:-1], k)), key=lambda b: (pad(b), len(b), b))
    out = []
    for k, b in enumerate(bounds):
        own = sorted(((i is None, i or 0, n) for i, n in rows if n <= b and (not k or n > bounds[k - 1])))
        size = max(1, budget // max(b, 1))
        out += [(None if none else i, n, k, b, at // size, at % size) for at, (none, i, n) in enumerate(own)]
    return out


def test_packing_against_all_boundaries(spark):
    rng = random.Random(11)
    for seed in range(3):
        pool = [rng.choice([0, 3, 17, 600, 1001, 21_845, 54_006, 70_000]) + rng.randint(0, 2) for _ in range(9)]
        rows = [(rng.randrange(-(2**62), 2**62) if rng.random() < 0.7 else None, rng.choice(pool)) for _ in range(300)] + [(5, None), (5, 7), (5, 7), (6, -3)]
        got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 3, 65536).collect()
        key = lambda r: tuple((x is None, x or 0) for x in r)
        padding = lambda own: sum(r[3] - r[1] for r in own)
        mine = [(r.doc_id, r.n_tokens, r.bucket, r.boundary, r.batch, r.slot) for r in got]
        want = brute_packing(rows, 3, 65536)
        assert padding(mine) == padding(want)
        if {r[3] for r in mine} == {r[3] for r in want}:  # equally good boundaries may differ
            assert sorted(mine, key=key) == sorted(want, key=key)


def test_copies_are_written_out_in_runs(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 8)
    out = packing.pack(spark.createDataFrame([(None, 5)] * 100 + [(1, 5)] * 3 + [(2, 9)], "doc_id long, n_tokens long"), 2, 20).collect()
    assert sorted((r.batch, r.slot) for r in out if r.bucket == 0) == [(k // 4, k % 4) for k in range(103)]


def test_packing_keeps_every_row_within_the_budget(spark):
    rng = random.Random(7)
    rows = [(i * 5000 % 7919, rng.choice([0, 1, 5, 300, 257, 1000, 70_000])) for i in range(500)] + [(3, None), (None, 4), (None, 4)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 4, 2000).collect()
    assert len(out) == len(rows)
    batches = {}
    for r in out:
        assert r.padding == r.boundary - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for own in batches.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) * own[0].boundary <= 2000 or len(own) == 1
    for b in {r.bucket for r in out}:
        assert sorted({k for x, k in batches if x == b}) == list(range(len({k for x, k in batches if x == b})))


def language_rows():
    rng = random.Random(6)
    parts = {"en": "the and of ing tion with er", "de": "der und sch keit ung ein ich", "fr": "le eau tion que ment oir et", "es": "el ción os que ado ía la"}
    return [(i, " ".join("".join(rng.choice(parts[g].split()) for _ in range(rng.randint(1, 3))) for _ in range(40)), g) for i, g in enumerate([*parts] * 60)]


def test_language_by_held_out_rows(spark):
    rows = language_rows() + [(1000, None, "en"), (1001, "", None), (1002, "123 !!", "de"), (None, "the and", "en"), (1003, "漢字", None), (1004, LONG, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = language_id.language_id(d).collect()
    assert len(got) == len(rows)
    want = {i: g for i, _, g in rows}
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(held) > 30 and sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002)) and by[1003].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    model = language_id.train_languages(d)
    kept = language_id.known_languages(d, model)
    want = [r.doc_id for r in got if r.lang_pred != "und" and r.score >= language_id.LEAST]
    assert kept.columns == d.columns and sorted(map(str, want)) == sorted(str(r.doc_id) for r in kept.collect())
    french = language_id.known_languages(d, model, ["fr"], 0.5).collect()
    assert sorted(map(str, (r.doc_id for r in french))) == sorted(str(r.doc_id) for r in got if r.lang_pred == "fr" and r.score >= 0.5) and len(french) > 50
    # nothing can be learnt: only texts without letters go
    assert language_id.known_languages(d, language_id.LanguageModel()).count() == len(rows) - 3


def plain_features(text):
    """Pairs and triples of bytes of the folded text, by their numbers, in plain Python."""
    t = (text or "").lower().encode()
    t = b" " + re.sub(rb"[^a-z\x80-\xff]+", b" ", t).strip(b" ") + b" " if t.strip() else b"  "
    t = re.sub(rb" +", b" ", t)
    out = {}
    for i in range(len(t) - 1):
        out[t[i] << 8 | t[i + 1]] = out.get(t[i] << 8 | t[i + 1], 0) + 1
    for i in range(len(t) - 2):
        k = 65536 + (((t[i] << 16 | t[i + 1] << 8 | t[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 16)
        out[k] = out.get(k, 0) + 1
    return out, max(2 * len(t) - 3, 1)


def test_language_margins_against_plain_sums(spark):
    import numpy as np

    rows = [r for r in language_rows() if len(r[1]) > 20]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train_languages(d)
    assert model.families == ["germanic", "romance"] and model.pairs == [("de", "en"), ("es", "fr")]
    for _, text, _ in rows[:60]:
        raw = np.frombuffer(text.encode(), np.uint8)
        f, total = plain_features(text)
        want = sum((model.weights[k].astype(float) * n for k, n in f.items()), np.zeros(4)) / total + model.biases
        assert model.margins(raw, np.array([0, len(raw)]))[0] == pytest.approx(want, abs=1e-4)
    # the hierarchy, by plain rules on the margins
    texts = [t for _, t, _ in rows[:60]]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    langs, _ = model.predict(raw, bounds)
    for m, lang in zip(model.margins(raw, bounds), langs, strict=True):
        k = 0 if m[0] >= m[1] else 1
        assert lang == model.pairs[k][0 if m[2 + k] >= 0 else 1]


def test_svm_against_plain_gradient_descent():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=60) > 0.4, 1, -1)
    w, b = language_id.linear_svm([(np.arange(8), v) for v in x], y, cost=1.0, passes=400)
    c = np.array([60 / (2 * (y == s).sum()) for s in y])
    full, u = np.c_[x, np.ones(60)], np.zeros(9)
    for _ in range(20_000):  # 0.5 |u|^2 + sum c max(0, 1 - y u.x)^2
        gap = np.maximum(0, 1 - y * (full @ u))
        u -= 5e-4 * (u - 2 * full.T @ (c * y * gap))
    assert np.r_[w[:8], b] == pytest.approx(u, abs=1e-3)


def test_toxicity_by_held_out_rows(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["idiot", "moron", "Scum!"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1 if bad else 0))
    rows += [(2000, None), (2001, ""), (None, "idiot moron scum")]
    d, lab = clashing(spark, rows), spark.createDataFrame([*labels, (None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(d, toxicity.train_toxicity(d, lab)).collect()
    want = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(got) == len(rows) and sum(r.predicted == want[r.doc_id] for r in held) >= 0.95 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[2000].score == by[2001].score < 0.5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = toxicity.score_toxicity(d, toxicity.train_toxicity(d, lab.where("toxic = 0")))
    assert {r.score for r in none.collect()} == {0.0}


def test_toxicity_against_plain_regression(spark):
    """Ratios, features and weights in plain Python and by Newton's method."""
    import math

    import numpy as np

    rng = random.Random(15)
    words = ["lorem", "ipsum", "dolor", "amet", "elit"]
    rows, labels = [], []
    for i in range(200):
        w = [rng.choice(words) for _ in range(12)] + (["vile"] if i % 3 == 0 or rng.random() < 0.05 else [])
        rows.append((i, " ".join(rng.sample(w, len(w)))))
        labels.append((i, int(i % 3 == 0)))
    d = docs(spark, rows)
    model = toxicity.train_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(d, model).collect()}
    grams = lambda t: {(o, (" " + t + " ").encode()[i : i + o]) for o in (4, 5, 6) for i in range(len(t) + 3 - o)}
    learnt = [(grams(t), y) for (i, t), (_, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 5]
    n1, n0 = sum(y for _, y in learnt), sum(1 - y for _, y in learnt)
    ratio = {}
    for g in set().union(*(s for s, _ in learnt)):
        p, q = sum(y for s, y in learnt if g in s), sum(1 - y for s, y in learnt if g in s)
        a, b = (p + 1) / (n1 + 2), (q + 1) / (n0 + 2)
        r = math.log(a / (1 - min(a, 0.999))) - math.log(b / (1 - min(b, 0.999)))
        if p + q >= 3 and abs(r) / math.sqrt(1 / (p + 1) + 1 / (q + 1)) >= 3:
            ratio[g] = r
    names = sorted(ratio)
    assert len(names) == len(model.codes) > 0
    row = lambda s: [ratio[g] if g in s else 0.0 for g in names] + [1.0]
    x, y = np.array([row(s) for s, _ in learnt]), np.array([v for _, v in learnt], float)
    w, ridge = np.zeros(len(names) + 1), np.r_[np.ones(len(names)), 0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge) + 1e-9 * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    for i, t in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-float(np.dot(row(grams(t)), w)))), abs=0.02)


def test_nothing_is_left_in_the_shared_folder(spark, tmp_path):
    import os

    from terravane.llm.common import checkpoint_base, mark, release

    base, at = checkpoint_base(spark), mark()
    have = set(os.listdir(base)) if os.path.isdir(base) else set()
    d = docs(spark, near_copies(3, 30))
    for out in (line_dedup.dedup_lines(d), ngram_join.ngram_components(d), ngram_join.one_of_each(d), token_files.token_files(d), packing.pack(token_count.token_counts(d))):
        assert out.count() > 0
    assert set(os.listdir(base)) != have
    release(at)
    assert set(os.listdir(base)) == have


def test_empty_tables(spark):
    d = spark.createDataFrame([], SCHEMA + ", lang string")
    empty = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (
        secrets.scan_secrets(d), toxicity.score_toxicity(d, toxicity.train_toxicity(d, labels)), decontaminate.find_contamination(d, empty), token_files.token_files(d), exact_dedup.exact_groups(d),
        line_dedup.dedup_lines(d), ngram_join.ngram_components(d), token_count.token_counts(d), language_id.language_id(d), packing.pack(d.select("doc_id", F.lit(1).alias("n_tokens"))),
    ):
        assert out.count() == 0
    some = docs(spark, [(1, "a b")])
    assert decontaminate.find_contamination(some, empty).first().n_hit == 0


def test_contract_columns():
    from terravane.llm.queries import ORACLE_SQL, QUERIES

    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 11)} and set(ORACLE_SQL) <= set(QUERIES)
