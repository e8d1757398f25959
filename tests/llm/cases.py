"""A small fixture: given documents plus the cases that every operator must stand."""

import random

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, part int, key string, flags binary, text_hash string, pos int"


def documents():
    t = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    rows = [(int(a), b) for a, b in zip(t.doc_id[:60], t.text[:60])]
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage = prose(120).split(), prose(60)
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one two"), (1004, "é" * 30), (1005, "x" * 3000)]
    rows += [(1010 + i, "One Two three FOUR five six") for i in range(5)]
    rows += [(1020, rows[2][1]), (1020, rows[2][1]), (2, rows[2][1])]  # copies, a repeated row, a repeated id
    for i in range(25):  # near copies
        words = list(base)
        for _ in range(i % 5):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((1100 + i, " ".join(words)))
    rows += [(1200 + i, f"{prose(30)}\n{passage}\n{prose(20 + i)}") for i in range(20)]  # a shared passage
    rows += [(1300, "ab " * 700), (1301, "ab " * 400 + "end"), (1302, prose(6000)), (1303, "Ünï çode " + prose(50).upper())]
    rows += [
        (1400, "mail a.b@c.d_x@e.f.g or bob@host and x@y.zz! 1.2.3.4.5 999.1.1.1 10.20.30.40"),
        (1401, "card 4644 3483 9801 0899, 4644348398010899 1234567890123456 x +1 (706) 555-3138 and more words (212) 555-0199 end"),
        (1402, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ok'),
        (1403, "Released under the MIT License. Licensed under the Apache License, Version 2.0. CC BY-NC"),
        (1404, "this work is licensed under a GNU general public license version 3"),
        (1405, "<|endoftext|> twice <|endoftext|>'s it's 12345   \n\n end"),
        (1406, "1" * 5000 + "." + "2" * 50 + "+" * 40 + "@" * 30),
    ]
    return rows


def benchmark():
    t = pq.read_table(f"{SF}/benchmark.parquet").to_pandas()
    rows = [(int(a), b) for a, b in zip(t.item_id[:20], t.text[:20])]
    docs = [text for _, text in documents() if text]
    rows += [(100, " ".join(docs[0].split()[5:40])), (101, docs[3][:200]), (102, "One two"), (103, None), (104, ""), (100, "ab ab")]
    rows += [(105, " ".join(["ab"] * 20)), (None, docs[5])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [(d, t, "en", "src", None if t is None else len(t), "w", 1, 2, None, None, "h", 0) for d, t in rows], SCHEMA
    )


def with_null_id(rows):
    return [*rows, (None, "no identity " * 20)]
