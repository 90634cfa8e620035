"""The pipeline against plain Python, stage by stage, on a small folder of tables."""

import base64
import hashlib
import random

import brute
import public_tokenizers
import tiktoken

import corpus_pipeline
from takerank.llm import pii

KEY = "a key of the tests"


def test_pipeline_against_plain_python(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    items = [(i, line(n)) for i, n in enumerate((12, 20, 33))]
    cards, addresses = ["4041894974608795", "4111111111111111"], ["190.137.223.204", "25.86.162.211"]
    rows = [(None, None, "en", "s", 0), (7000, None, "en", "s", 0), (7001, "", None, None, 0)]
    bodies = ["\n".join(line(rng.randrange(8, 30)) for _ in range(rng.randrange(2, 6))) for _ in range(40)]
    for i in range(120):
        text = rng.choice(bodies)
        if i % 3 == 0:
            w = text.split(" ")
            w[rng.randrange(len(w))] = word()
            text = " ".join(w)
        if i % 5 == 0:
            text += "\nClick here | Home | News"
        if i % 7 == 0:
            text += "\n" + items[i % 3][1]
        if i % 4 == 0:
            text += f"\nPay {rng.choice(cards)}, from {rng.choice(addresses)}; or Some.One{i}@x.example at once."
        if i % 11 == 0:
            text = "spam!! " * 40
        rows.append((i, text, "en", "s", len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.conf.set(pii.KEY_SETTING, KEY)

    docs = [(r[0], brute.quality(r[1])[8]) for r in rows if brute.quality(r[1])[7]]
    label = brute.components(docs)
    docs = [(i, t) for i, t in docs if label[i] == i]
    found = {i for i, _ in brute.leaks(docs, items)}
    assert found and len(found) < len(docs)
    docs = [(i, t) for i, t in docs if i not in found]

    def hidden(t):
        for c in cards:
            t = t.replace(c, brute.card(c, KEY))
        for a in addresses:
            t = t.replace(a, brute.ipv4(a, KEY))
        return " ".join(brute.email(w, KEY) if "@" in w else w for w in t.split(" "))

    docs = [(i, hidden(t)) for i, t in docs]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: hashlib.sha256(" ".join(map(str, library.encode_ordinary(t))).encode()).hexdigest() for i, t in docs}
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r.doc_id: r.ids_sha256 for r in got} == want and len(got) == len(want) > 10


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
