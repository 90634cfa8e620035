import base64
import glob
import hashlib
import os
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from brute import WORD, components, leaks, low, luhn, shingles
from pyspark.sql import functions as F

from takerank.llm import bpe, decontaminate, html_text, licenses, near_dedup, pii, quality, secrets, sharding, warc, wordhash

KEY = "a key of the tests"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
EXTRA = "doc_id long, text string, key string, row string, n_words string, t string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "k", None, "x", "t") for i, t in texts], EXTRA)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (6, "a b c d e"), (7, "A b c d e"), (8, "x " * 3000)]
    rows += [(100 + i, edited(rng, base, rng.randrange(0, 9))) for i in range(60)] + [(300, rows[-1][1]), (301, rows[-1][1])]
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingles(dict(rows)[r.doc_id])) for r in got)
    kept = near_dedup.deduplicate(docs(spark, [*rows, rows[0], rows[9]]))
    assert kept.columns == [c.split()[0] for c in EXTRA.split(", ")] and sorted(r.doc_id for r in kept.collect()) == sorted(set(components(rows).values()))


def test_near_duplicates_of_nothing_and_null_ids(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    got = near_dedup.near_duplicates(docs(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True), ("1", "1", True), ("None", "None", True)]


def test_sets_that_share_a_digest(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(12))) for i in range(30)]
    rows += [(100 + i, t) for i, t in rows[:5]]
    got = near_dedup.near_duplicates(docs(spark, rows), key_bits=2).collect()
    assert {r.doc_id: r.component_id for r in got} == components(rows)


def test_rows_without_an_id_stay(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z"), (3, "x y z"), (3, "another text"), (4, None)]
    kept = near_dedup.deduplicate(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in [*rows[:3], rows[4], *rows[6:]])


def test_parity_count_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 150, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.integers(0, 40) :], rng.integers(0, 2**63, rng.integers(0, 60), dtype=np.uint64)]))
        x, y = (np.frombuffer(near_dedup.parity(s), np.uint64)[None] for s in (a, b))
        width = min(x.shape[1], y.shape[1]) * 64
        assert np.bitwise_count(near_dedup._fold(x, width) ^ near_dedup._fold(y, width)).sum() <= len(np.setxor1d(a, b))


def test_licenses(spark):
    mit = "Copyright (c) 2020 Someone\n\n" + licenses.NOTICES[0][1].replace("software", "SOFTWARE").replace(",", " ,")
    rows = [(1, mit), (2, "Prose.\nReleased under the MIT Licence!\nMore prose."), (3, "Nothing here, all rights reserved."), (4, None), (5, "licensed under cc by-nc 4.0")]
    got = {r.doc_id: (r.licenses, r.whole_license) for r in licenses.report(docs(spark, rows)).collect()}
    assert got == {1: ("MIT", "MIT"), 2: ("MIT", None), 3: ("", None), 4: ("", None), 5: ("CC-BY-NC-4.0", "CC-BY-NC-4.0")}


def test_licenses_of_many_paragraphs_inside_text(spark):
    mit, isc, full = licenses.NOTICES[0][1], licenses.NOTICES[4][1], dict(licenses.full_texts())
    rows = [(1, f"Prose.\n\n{mit}\n\nCode."), (2, f"code()\n{isc}"), (3, "\n".join(["Intro", *(f"# {x}" for x in full["Apache-2.0"].split("\n")), "end"])), (4, full["GPL-3.0"]), (5, mit.split("\n\n")[0]), (6, f"a\n\n{full['BSD-3-Clause']}\n\n{mit}".replace(" the ", "\nthe "))]
    got = {r.doc_id: (r.licenses, r.whole_license) for r in licenses.report(docs(spark, rows)).collect()}
    assert got == {1: ("MIT", None), 2: ("ISC", None), 3: ("Apache-2.0", None), 4: ("GPL-3.0", "GPL-3.0"), 5: ("", None), 6: ("BSD-3-Clause,MIT", None)}


def python_spans(text):
    out = []
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    out += [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_secrets_against_regular_expressions(spark):
    rng = random.Random(7)
    parts = ["token=token:abcdefg", 'API_KEY: "', "passwd = ", "secret:", "é中😀", "\n", "a1b2c3d4" * 4, "AKIA" + "Z9" * 9, "AKIAX ", "abc", "0" * 23, "Token='x.y/z+=-", " ", "ghp_" + "a" * 40]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(300)] + [(900, None), (901, "password=" + "a" * 50000)]
    got = {r.doc_id: (r.base_sha256, r.spans) for r in secrets.report(docs(spark, rows)).collect()}
    for i, t in rows:
        assert got[i][0] == hashlib.sha256(python_spans(t or "").encode()).hexdigest(), t
    assert any("github" in s for _, s in got.values())
    assert secrets.scan(docs(spark, rows)).columns[-1] == "secrets" and secrets.report(docs(spark, [])).count() == 0


def test_trigram_queries():
    assert secrets.literals("ab(?:cde|fghi)jk") == ["abcde", "abfghi"]
    assert secrets.literals("[0-9a-f]{24,}") == [] and secrets.trigrams("abcd") == ["abc", "bcd"]


def test_quality(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(1, good), (2, None), (3, ""), (4, "too few words"), (5, " ".join(f"W{i}!!" for i in range(60))), (6, "\n".join([good] * 4)), (7, " | ".join(f"w{i}" for i in range(60))), (8, good + "\nAll rights reserved."), (9, " ".join(f"v{i // 7}" for i in range(70))), (10, " ".join(f"a{i}" for i in range(30)) + " " + "z " * 20000)]
    got = {r.doc_id: r for r in quality.measure(docs(spark, rows)).collect()}
    assert {i for i, r in got.items() if r.kept} == {1, 8}
    for i, t in rows:
        w = WORD.findall(t or "")
        wins = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        again = {k + j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(8)} if len(w) < 500 else None
        assert got[i].n_words == len(w) and got[i].word_chars == sum(map(len, w)) and (again is None or got[i].n_repeat_words == len(again))
    out = quality.clean(docs(spark, rows)).collect()
    assert {r.doc_id: r.text for r in out} == {1: good, 8: good} and quality.measure(docs(spark, [])).count() == 0


def test_quality_counts_boilerplate(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    stock = [f"Click here for page{i} of our privacy policy" for i in range(9)]
    rows = [(1, "\n".join(stock)), (2, "\n".join([good, *stock])), (3, good + "\n" + stock[0]), (4, good + "\nTous droits réservés\nAlle Rechte vorbehalten\nTodos los derechos reservados")]
    assert {r.doc_id: r.text for r in quality.clean(docs(spark, rows)).collect()} == {3: good, 4: good}


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "u3", "<p>é</p>"), (1, "u1", "<p>é</p>"), (2, None, None), (4, "u4", ""), (None, "n", "x"), (7, "u7", "long " * 50000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {3: ("revisit", 1), 1: ("response", None), 2: ("response", None), 4: ("revisit", 2), None: ("response", None), 7: ("response", None)}
    for i, _, h in rows:
        data = (h or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    path = f"file://{tmp_path}/archive"
    warc.write(pages, path)
    record = warc.read(spark, path).where("page_id = 1").first().record
    assert bytes(record).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and bytes(record).endswith("<p>é</p>\r\n\r\n".encode())
    length = int(re.search(rb"\r\nContent-Length: (\d+)\r\n\r\nHTTP", bytes(record))[1])
    assert length == len(bytes(record).split(b"\r\n\r\n", 1)[1]) - 4
    assert spark.read.parquet(f"{path}/payloads").count() == 4 and warc.round_trip(pages.limit(0)).count() == 0


def test_bpe_equals_the_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    letters = list("  \n\t  　'''ssttremdvl laeZ9٣½!?.é中😀\x00̀\x1c\x85")
    texts = [None, "", "it's", "x" * 5000, "ab" * 3000, "<|endoftext|>", " \n", *("".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(2000))]
    v = bpe.Vocabulary(open(PATH, "rb").read())
    for row, end, raw, offsets in wordhash.chunks(pa.array(texts), 2000):
        ids, at, _ = v.encode_checked(raw, offsets)
        for i in range(row, end):
            assert ids[at[i - row] : at[i - row + 1]].tolist() == library.encode_ordinary(texts[i] or "")
    d = docs(spark, list(enumerate(texts[:50])))
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(d, PATH), PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts[:50])}
    r = bpe.digests(d, PATH).where("doc_id = 2").first()
    assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, library.encode_ordinary("it's"))).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(b"it's").hexdigest()
    assert bpe.digests(docs(spark, []), PATH).count() == 0


def test_shards(spark, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/store", target=1 << 20)
    d = docs(spark, [(i, f"text {i}" if i % 3 else None) for i in range(40)])
    for part in range(4):
        store.append(d.where(F.col("doc_id") % 4 == part).coalesce(1))
    assert store.versions() == [1, 2, 3, 4] and len(store.shards()) == 4
    with pytest.raises(Exception, match="exist"):
        store.commit([], [], 3)
    store.compact()
    assert len(store.shards()) == 1 and store.read(d.schema, version=2).count() == 20
    lost = f"{tmp_path}/store/data/lost"
    d.limit(1).write.parquet(f"file://{lost}")  # a writer that lost the race
    open(f"{tmp_path}/store/_manifest/.x.tmp", "w").close()
    store.sweep()
    assert not glob.glob(f"{lost}/*.parquet") and sorted(f for f in os.listdir(f"{tmp_path}/store/_manifest") if not f.endswith(".crc")) == ["v00000005.json"]
    assert sorted(store.read(d.schema).collect(), key=lambda r: r.doc_id) == sorted(d.collect(), key=lambda r: r.doc_id)
    assert sharding.compacted(d.limit(0), f"file://{tmp_path}/empty").count() == 0
    odd = spark.createDataFrame([(None, "a", 1), (None, "a", 1), (3, None, None), (3, "b" * 100000, 2)], "doc_id long, text string, _arrival long")
    back = sharding.compacted(odd, f"file://{tmp_path}/odd")
    assert back.columns == odd.columns and sorted(map(str, back.collect())) == sorted(map(str, odd.collect()))
    many = sharding.Store(spark, f"file://{tmp_path}/many")
    for i in range(19):
        many.commit([{"file": f"f{i}", "bytes": 1, "level": 0}], [f"f{i - 1}"] if i % 2 else [], i)
    assert {x["file"] for x in many.shards()} == {f"f{i}" for i in range(19) if i % 2 or i == 18}


def test_pseudonyms(spark):
    rows = [(1, "a.b+c@mail.example.com 4041894974608795, +1 (386) 555-3733; 25.86.162.211. 123-45-6789 1985-04-12"), (2, "again 4041-8949-7460-8795 and 04/12/1985"), (3, "4041894974608796 999-45-6789 2024-02-30 300.1.1.1 v1.2"), (4, None), (5, ""), (6, "clean " * 20000)]
    got = {r.doc_id: r for r in pii.pseudonymise(docs(spark, rows), KEY).collect()}
    a = got[1].text
    for secret in ("a.b+c@", "4041894974608795", "386", "25.86.162.211", "123-45-6789", "1985-04-12"):
        assert secret not in a
    card = re.search(r"\d{16}", a)[0]
    assert luhn(card) and card in got[2].text.replace("-", "") and re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", re.search(r"\+1 \S+ \S+(?=;)", a)[0])
    year, month, day = re.search(r"(\d{4})-(\d\d)-(\d\d)$", a).groups()
    assert f"{month}/{day}/{year}" in got[2].text
    assert got[3].text == rows[2][1] and got[4].text is None and got[5].text == "" and got[6].text == rows[5][1]
    other = pii.pseudonymise(docs(spark, rows[:1]), "other").first().text
    assert other != a


def test_pseudonyms_end_where_the_value_ends(spark):
    card, phone = "4111 1111 1111 1111", "+1 (826) 555-4081"
    rows = [(1, card), (2, phone), (3, "+44 20 7946 0958"), (4, "4111111111111111"), (5, "190.137.223.204")]
    after = [f"{phone} 190.137.223.204", f"{phone} 1234", "+44 20 7946 0958 190.137.223.204", "+44 20 7946 0958 12.5", "+44 20 7946 0958 2024-02-30", f"{card} 12", "4111111111111111 215", "7 4111111111111111", f"99 {card}", f"{card}  {card}", "4111111111111111 4111111111111111", f"{phone} {card} 12"]
    got = {r.doc_id: r.text for r in pii.pseudonymise(docs(spark, rows + list(enumerate(after, 10))), KEY).collect()}
    alone = {t: got[i] for i, t in rows}
    for i, t in enumerate(after, 10):
        for n, value in enumerate(alone):
            t = t.replace(value, f"<{n}>")
        for n, new in enumerate(alone.values()):
            t = t.replace(f"<{n}>", new)
        assert got[i] == t
    assert all(got[i] != t for i, t in rows)
    counted = pii.pseudonymise(docs(spark, [(1, f"{card}  {card} 12"), (2, "+123 1234 1234 1234 1234")]), KEY).orderBy("doc_id").collect()
    assert [(r.n_card, r.n_phone) for r in counted] == [(2, 0), (0, 1)]


def test_pseudonyms_permute(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    assert df.select(pii.permute_symbols(F.col("s"), F.lit("ddd"), "k", "x").alias("p")).distinct().count() == 1000
    pairs = spark.range(21 * 5).select(pii.permute_pair(F.floor(F.col("id") / 5), F.col("id") % 5, (21, 5), "k", "x").alias("p"))
    assert pairs.distinct().count() == 105


def test_main_text():
    long = "Running text with commas, clauses, and more of it so that it counts. " * 3
    page = f"<html><head><title>T</title><body><div id=header>site</div><ul class=menu><li>One</ul><div class=content><h1>Head &amp; line</h1><p>{long}<p>a<br>b <b>{long}<div class=ad>Buy</div></div><div class=sidebar><p>{long}</p></div><div class=comments><p>{long}</p></div><footer>x</footer>"
    assert html_text.main_text(page).split("\n\n") == ["Head & line", long.strip(), f"a b {long.strip()}"]
    assert html_text.main_text(None) == "" and html_text.main_text("<p>short</p>") == "short" and html_text.main_text("<div>" * 5000 + "deep").strip() == "deep"


def test_main_text_in_wrappers_with_telling_names():
    long = "Running text with commas, clauses, and more of it so that it counts. " * 3
    body = f"<p>{long}</p><p>{long}</p>"
    want = [long.strip()] * 2
    for name in ("content has-sidebar", "no-sidebar", "post comments-open", "commentary", "hidden-print article-body", "social-policy", "search-result-page", "nav-wrapper", "menus", "comments"):
        page = f"<html><body><ul class=menu><li><a href=x>{long}</a></ul><div class='{name}'>{body}</div><div class=ad><p>{long}</p></div></body></html>"
        if name == "comments":
            page = page.replace("class=ad", "class=post")
            assert html_text.main_text(page).split("\n\n") == want[:1]
            assert html_text.main_text(f"<div class={name}>{body}</div>").split("\n\n") == want
        else:
            assert html_text.main_text(page).split("\n\n") == want, name
    assert html_text.main_text(f"<body>{body}<div class=promo><p>Buy our splendid things now, all of you.</p></div>").split("\n\n") == want


def test_decontamination_against_brute_force(spark):
    rng = random.Random(2)
    items = [" ".join(f"w{rng.randrange(400)}" for _ in range(n)) for n in (3, 12, 20, 33, 50)]
    rows = [(9000, None), (9001, ""), (9002, "x")]
    for i in range(150):
        k = rng.randrange(5)
        body = edited(rng, items[k].split(), rng.randrange(0, 3))
        text = " ".join([f"p{rng.randrange(99)}" for _ in range(rng.randrange(20))] + [body] + [f"q{rng.randrange(99)}" for _ in range(rng.randrange(20))])
        rows.append((i, text))
    bench = spark.createDataFrame([*((i, t) for i, t in enumerate(items)), (77, None), (78, "")], "item_id long, text string")

    truth = leaks(rows, list(enumerate(items)))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs(spark, rows), bench).collect()}
    assert got.keys() == truth.keys() and all(abs(got[k] - truth[k]) < 1e-9 for k in truth)
    clean = decontaminate.decontaminate(docs(spark, rows), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in truth}
