"""Each operator against its plain version, with nulls, empty and very long texts, repeated rows, empty tables and extra columns."""

import base64
import hashlib
import random

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from takerank.llm import bpe, cluster, decontaminate, html_text, licenses, near_dedup, pii, quality, secrets, warc, wordhash

KEY = "a key of the tests"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
EXTRA = "doc_id long, text string, row string, t string, rid string, words string, kept string, _copy string, _kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "t", "r", "w", "k", "c", None) for i, t in rows], EXTRA)


def same_rows(df, rows, value):
    """The results of rows, as a sorted list, equal those of value(text)."""
    got = sorted(map(repr, ((r[0], *r[1:]) for r in df.collect())))
    assert got == sorted(repr((i, *value(t))) for i, t in rows)


def test_quality_against_plain_rules(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["end.", "so,", "what?", "wow!!", "a#", "|", ">", "·", "é", "中文。"]
    stock = ["All rights reserved", "Click here for it.", "Our Privacy Policy was changed in a long sentence, which tells of many other things as well, and stays for that."]
    line = lambda: rng.choice([" ".join(rng.choice(words) for _ in range(rng.randrange(16))), rng.choice(stock), "same line, here.", " a\tb ", "x x x x y", "Home > News > Local Sports"])
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 12)))) for i in range(400)]
    rows += [(None, None), (None, None), (900, ""), (901, rows[0][1]), (0, rows[0][1]), (902, "word and word, " * 20000), (903, "\n".join(f"line {i}, and more of it than before." for i in range(3000)))]
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept", "clean_text"]
    same_rows(quality.measure(docs(spark, rows)).select(*columns), rows, brute.quality)
    kept = [(i, brute.quality(t)[8]) for i, t in rows if brute.quality(t)[7]]
    out = quality.clean(docs(spark, rows))
    assert out.columns == docs(spark, []).columns and sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, kept)) and all(t.strip() for _, t in kept)
    assert 20 < len(kept) < 380 and quality.report(docs(spark, [])).count() == 0


def test_licenses_of_odd_tables(spark):
    mit = licenses.NOTICES[0][1]
    rows = [(None, mit), (None, mit), (1, ("Prose of no licence.\n" * 20000) + mit.replace(" the ", " the\n")), (2, "x\n" * 30000), (3, None), (3, "To fulfil, it. Licensed under the MIT licence!")]
    out = licenses.scan(docs(spark, rows))
    assert sorted((str(r.doc_id), r.licenses, str(r.whole_text), r.kept) for r in out.collect()) == [("1", ["MIT"], "None", "k"), ("2", [], "None", "k"), ("3", [], "None", "k"), ("3", [], "None", "k"), ("None", ["MIT"], "MIT", "k"), ("None", ["MIT"], "MIT", "k")]
    own = spark.createDataFrame([("own", "You shall fulfil, all of it."), ("empty", "?!")], "license_id string, text string")
    found = licenses.scan(docs(spark, [(1, "you shall FULFILL all of it"), (2, "?!")]), own).select("doc_id", "licenses", "whole_text").collect()
    assert sorted(map(tuple, found)) == [(1, ["own"], "own"), (2, [], None)] and licenses.report(docs(spark, [])).count() == 0


def test_secrets_of_odd_tables(spark):
    rows = [(None, "password=abcdef"), (None, "password=abcdef"), (1, None), (1, "x" * 200000 + " AKIA" + "A" * 16), (1, "")]
    out = secrets.scan(docs(spark, rows))
    assert out.columns == [*docs(spark, []).columns, "secrets"]
    got = sorted((str(r.doc_id), [(s.start, s.kind, s.end) for s in r.secrets]) for r in out.collect())
    assert got == [("1", []), ("1", []), ("1", [(200001, "access", 200021)]), ("None", [(0, "assign", 15)]), ("None", [(0, "assign", 15)])]
    assert secrets.report(docs(spark, [])).count() == 0


def test_warc_of_odd_pages(spark, tmp_path):
    bad = "http://a/\nWARC-Refers-To: <urn:uuid:1#7>\r\nWARC-Payload-Digest: sha1:AAAA\U0001f600 %41|"
    rows = [(5, bad, "a"), (5, bad, "a"), (4, None, None), (9, "u", "a"), (2, "u", "é\r\n\r\nx"), (None, "u", "a")]
    pages = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id long, url string, html string, record long, header string")
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert got == sorted([("5", 1, "response", None), ("5", 1, "response", None), ("4", 0, "response", None), ("9", 1, "revisit", 5), ("2", 7, "response", None), ("None", 1, "revisit", 5)])
    warc.write(pages, f"file://{tmp_path}/a")
    found = warc.read(spark, f"file://{tmp_path}/a").where("page_id = 5").first()
    head = bytes(found.record).split(b"\r\n\r\n")[0].decode("ascii")
    assert found.url == bad and "WARC-Target-URI: http://a/%0AWARC-Refers-To:%20%3Curn:uuid:1#7%3E%0D%0AWARC-Payload-Digest:%20sha1:AAAA%F0%9F%98%80%20%41%7C\r\n" in head
    names = spark.createDataFrame([("a>b #", "u", "x"), ("", "u", "x"), ("z", "u", "x")], "page_id string, url string, html string")
    assert sorted((r.page_id, r.refers_to) for r in warc.round_trip(names).collect()) == [("", None), ("a>b #", ""), ("z", "")]
    small = warc.round_trip(pages, least_bytes=2).collect()
    assert all(r.record_type == "response" for r in small)


def test_bpe_beyond_the_cache(spark, monkeypatch):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(3000)), "again " * 50, ""]
    monkeypatch.setattr(bpe, "CACHED", 100)
    v = bpe.Vocabulary(open(PATH, "rb").read())
    for row, end, raw, offsets in wordhash.chunks(pa.array(texts), 1 << 20):
        ids, at, _ = v.encode_checked(raw, offsets)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode_ordinary(t) for t in texts[row:end]]
        assert len(v.keys) <= 100
    rows = [(None, "twice"), (None, "twice"), (1, None), (1, "")]
    same_rows(bpe.digests(docs(spark, rows), PATH), rows, lambda t: (len(library.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, library.encode_ordinary(t or ""))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert bpe.encode(docs(spark, []), PATH).count() == 0


def test_pseudonyms_against_a_plain_network(spark):
    p = brute.phone("3865553733", KEY)
    grouped = lambda a: f"({a[:3]}) {a[3:6]}-{a[6:]}"
    pairs = [
        ("4041 8949 7460 8795", (lambda c: " ".join(c[i : i + 4] for i in range(0, 16, 4)))(brute.card("4041894974608795", KEY))),
        ("190.137.223.204", brute.ipv4("190.137.223.204", KEY)),
        ("Foo.Bar+9@x.example", brute.email("Foo.Bar+9@x.example", KEY)),
        ("foo.bar+9@x.example", brute.email("foo.bar+9@x.example", KEY)),
        ("1985-12-25", brute.date("1985-12-25", KEY)),
        ("25/12/1985", "/".join(reversed(brute.date("1985-12-25", KEY).split("-")))),
        ("25.12.1985", ".".join(reversed(brute.date("1985-12-25", KEY).split("-")))),
        ("+1 (386) 555-3733", "+1 " + grouped(p)),
        ("(386) 555-3733", grouped(p)),
        ("386-555-3733", f"{p[:3]}-{p[3:6]}-{p[6:]}"),
        ("+13865553733", "+1" + p),
        ("+442079460958", "+44" + brute.feistel("2079460958", [("0", 10)] * 10, KEY, "phone")),
        ("no 386-155-3733, 31/02/1990, 123-456-7890 or 4041894974608796 or DE00 3704 0044 0532 0130 00", None),
    ]
    rows = [(i, f"x {a}; y") for i, (a, _) in enumerate(pairs)] + [(900, None), (901, ""), (None, pairs[0][0]), (None, pairs[0][0]), (902, "clean, " * 30000 + pairs[1][0])]
    got = pii.pseudonymise(docs(spark, rows), KEY)
    texts = [(r.doc_id, r.text) for r in got.collect()]
    for i, (a, b) in enumerate(pairs):
        assert dict(texts)[i] == f"x {b or a}; y"
    assert dict(texts)[900] is None and dict(texts)[901] == "" and dict(texts)[902].endswith(" " + pairs[1][1]) and [t for i, t in texts if i is None] == [pairs[0][1]] * 2
    assert pii.without_personal_data(docs(spark, []), KEY).count() == 0 and got.columns[: len(EXTRA.split(", "))] == [c.split()[0] for c in EXTRA.split(", ")]


def test_accounts_in_groups(spark):
    rows = [(1, "DE89370400440532013000"), (2, "DE89 3704 0044 0532 0130 00"), (3, "DE89 3704 0044 0532 0130 00 WORD and 4111 1111 1111 1111"), (4, "4111111111111111")]
    got = {r.doc_id: r for r in pii.pseudonymise(docs(spark, rows), KEY).collect()}
    solid, groups = got[1].text, got[2].text
    turned = "".join(str(int(c, 36)) for c in solid[4:] + solid[:4])
    assert groups.replace(" ", "") == solid != rows[0][1] and int(turned) % 97 == 1 and [len(g) for g in groups.split()] == [4, 4, 4, 4, 4, 2]
    assert got[3].text.startswith(groups + " WORD and ") and got[3].text.replace(" ", "").endswith(got[4].text) and (got[3].n_iban, got[3].n_card) == (1, 1)


def test_main_text_of_odd_pages(spark):
    long = "Running text with commas, clauses, and more of it so that it counts. " * 3
    page = f"<body><p title=it's>{long}</p><a href=/x/>link</a><p class=a\"b>{long}</p><div class='menu'><a href=x>m</a></div></body>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<div>" * 30000 + "<b>" * 3000 + f"<p>{long}"), (4, "l", f"<p>{long}</p>" * 20000)]
    out = html_text.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string"))
    got = out.collect()
    one = long.strip()
    assert out.columns == ["page_id", "url", "text", "n_chars"] and [r.text for r in got if r.page_id == 1] == [f"{one}\n\nlink\n\n{one}"] * 2
    assert {r.page_id: r.text for r in got if r.page_id != 1} == {2: "", None: "", 3: one, 4: "\n\n".join([one] * 20000)} and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    for items in (5, 6000):  # fewer and more values than neighbours of one
        prints = rng.integers(0, 65536, (items, 16), dtype=np.uint16)
        mine = prints[rng.integers(0, items, 40)].copy()
        for i in range(40):
            for x in rng.choice(256, rng.integers(0, decontaminate.RADIUS + 1), replace=False):
                mine[i, x // 16] ^= np.uint16(1 << (x % 16))
        got = set(zip(*(x.tolist() for x in decontaminate.MultiIndex(prints).candidates(mine)), strict=True))
        apart = np.bitwise_count(mine[:, None] ^ prints[None])
        assert got == set(zip(*(x.tolist() for x in np.nonzero(apart.min(axis=2) <= decontaminate.NEAR)), strict=True))
        assert got >= set(zip(*(x.tolist() for x in np.nonzero(apart.sum(axis=2) <= decontaminate.RADIUS)), strict=True))


def test_decontamination_of_odd_tables(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(24))) for i in range(40)] + [(99, None), (98, ""), (0, "repeated id")]
    bench = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, doc_id string")
    filler = lambda n: " ".join(f"f{rng.randrange(9)}" for _ in range(n))
    rows = [(i, f"{filler(30)} {items[i][1]} {filler(30)}") for i in range(20)]
    rows += [(0, rows[0][1]), (None, rows[1][1]), (50, None), (51, ""), (52, f"{filler(60000)} {items[5][1].upper()} {filler(10)}"), (53, filler(100)), (54, " ".join(items[7][1].split()[:20]))]
    got = sorted((str(r.doc_id), r.item_id, round(r.similarity, 9)) for r in decontaminate.leaks(docs(spark, rows), bench).collect())
    small = [x for x in rows if len(x[1] or "") < 10000]
    want = [(str(i), item, round(s, 9)) for n, (i, t) in enumerate(small) for (_, item), s in brute.leaks([(n, t)], items[:40]).items()] + [("52", 5, 1.0)]
    assert got == sorted(want)
    clean = decontaminate.decontaminate(docs(spark, rows), bench)
    assert clean.columns == docs(spark, []).columns and sorted(str(r.doc_id) for r in clean.collect()) == ["50", "51", "53"] + (["54"] if not any(x[0] == "54" for x in want) else [])
    assert decontaminate.leaks(docs(spark, []), bench).count() == 0 and decontaminate.leaks(docs(spark, rows), bench.limit(0)).count() == 0 and decontaminate.decontaminate(docs(spark, rows), bench.limit(0)).count() == len(rows)


def test_near_duplicates_with_clashing_names(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "x")]
    kept = near_dedup.deduplicate(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns and sorted(r.doc_id for r in kept.collect()) == [1, 3] and near_dedup.deduplicate(docs(spark, [])).count() == 0


def test_spread_join_equals_a_join(spark):
    left = spark.createDataFrame([(1 if i % 3 else i % 50 if i % 7 else None, i) for i in range(6000)], "k long, v long")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(1, 40)], "k long, r string")
    for how in ("inner", "left"):
        got = cluster.join_spread(left, right, "k", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect())) and "_copy" in got._jdf.queryExecution().toString()


def test_hot_groups_of_near_duplicates(spark):
    rng = random.Random(12)
    words = [f"w{rng.randrange(900)}" for _ in range(60)]
    near = lambda: " ".join(w if rng.random() > 0.02 else f"e{rng.randrange(10**6)}" for w in words)
    rows = [(i, " ".join(words)) for i in range(300)] + [(1000 + i, near()) for i in range(350)]
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute.components(rows)


def test_scratch_tables_of_near_duplicates_have_few_parts(spark, monkeypatch):
    """Each part costs the executor files and child processes; with many shuffle partitions a small table still gets few parts."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(40)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate([*texts, *(f"{t} {t[:3]}" for t in texts)])]
    parts = {}

    def counted(self, df, name, stored=cluster.Scratch.stored):
        out = stored(self, df, name)
        parts.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(cluster.Scratch, "stored", counted)
    settings = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute.components(rows) and len(set(got.values())) == 200
    assert max(max(n) for name, n in parts.items() if name != "sketches") <= 2 * spark.sparkContext.defaultParallelism, parts
