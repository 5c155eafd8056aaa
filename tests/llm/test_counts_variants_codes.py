"""Token counts, spelling variants and vector codes against the library and brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkwell.llm.queries import QUERIES
from inkwell.llm.tokencounts import count_tokens, token_counts
from inkwell.llm.transducer import CountTransducer, class_table, piece_starts, prefix_scan
from inkwell.llm.variants import followed, near_words, one_edit, typed_words, variant_groups
from inkwell.llm.vectorcodes import BOUND, codebooks_sha256, vector_codes

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def transducer():
    return CountTransducer(BPE)


def library_counts(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


PLANTED = [
    "", " ", "  ", "\n", " \n a", "a  ", "'s", "''s", "x's 're'll 'd'vx'r 'l", " 's", "\t's", "'", "'r", "'re", "<|endoftext|>", "a<|endoftext|> b  <|endoftext|>", "<|endoftext", "日本語テキスト 한국어 ١٢٣",
    "é" * 200, " " * 3000, "\n" * 1500 + "x", "a" * 5000, "ab" * 2000 + "'s", "\x00\x01\x1c \x85b", "🙂🙂‍↔️", "12345 67 ²³ ½", "don't CAN'T we'LL",
]


def test_counts_planted_texts(transducer, library):
    assert count_tokens(PLANTED, transducer).tolist() == library_counts(library, PLANTED)


@pytest.mark.parametrize("alphabet", ["aestrdvlm'' \n\t  1é日<|endoftext|>\x85\x1c!.٣🙂", "etaoinshrdlu ", "aab ", "'srevlldtm "])
def test_counts_random_texts(transducer, library, alphabet):
    r = random.Random(5)
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(1500)]
    assert count_tokens(texts, transducer).tolist() == library_counts(library, texts)


def test_a_full_table_starts_anew_without_changing_counts(library):
    r = random.Random(6)
    texts = ["".join(r.choice("abcdefghij klm") for _ in range(120)) for _ in range(300)] + ["".join(r.choice("abcdefgh") for _ in range(4000))]
    small = CountTransducer(BPE, states_kept=400)
    assert [int(count_tokens([t], small)[0]) for t in texts] == library_counts(library, texts)


def test_state_maps_compose_as_reading_from_the_start():
    """Whatever the size of the chunks, the prefix scan gives the starts that one chunk gives."""
    r = random.Random(7)
    classes = class_table()[np.array([ord(c) for c in "".join(r.choice("a's 're\n 1.! l") for _ in range(4000))])]
    whole = piece_starts(classes, chunk=len(classes))
    for chunk in (1, 2, 3, 17, 512):
        assert (piece_starts(classes, chunk) == whole).all()
    maps = np.array([[1, 2, 0], [1, 1, 2]], np.uint8).T[:, [0, 1, 0]]
    assert prefix_scan(maps)[:, 2].tolist() == [int(maps[maps[maps[s, 0], 1], 2]) for s in range(3)]


def test_classes_of_all_code_points_are_the_library_s(library):
    """Letters, digits and white space as the library's pattern sees them, but for code points newer than one of both tables."""
    pre = library.pre_tokenizer
    table, differ = class_table(), 0
    for cp in range(0, 0x3000):
        pieces = len(pre.pre_tokenize_str("a" + chr(cp) + "1"))
        kind = int(table[cp])
        want = 2 if kind in (3, 4, 7, 8, 9, 10) else 3
        differ += pieces != want
    assert differ <= 8


def test_counts_every_row(spark, library):
    rows = [(1, None, "x"), (1, "two words", "x"), (None, "two words", "x"), (2, "", None), (3, "w" * 20000 + " end", "y"), (4, "naïve <|endoftext|>" * 300, "y")]
    df = spark.createDataFrame([(i, t, c, c, 7) for i, t, c in rows], "doc_id long, text string, id string, t string, n_tokens int")
    got = sorted(map(tuple, token_counts(df, BPE).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        n = library_counts(library, [t or ""])[0]
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=repr)
    assert token_counts(df.limit(0), BPE).collect() == []


def test_op11_equals_the_library(spark, library):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    texts = [t or "" for _, t in rows]
    want = sorted((i, len(t.encode()), n, n > 512) for (i, _), t, n in zip(rows, texts, library_counts(library, texts)))
    got = QUERIES["op11_token_counts"](spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and sorted(map(tuple, got.collect())) == want


def counted(rows):
    c = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 97 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            c[r] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}


def grouped(c):
    """word: (n, n_near, form, form_n, root), from the deletions of every word."""
    shorter, near = defaultdict(set), defaultdict(set)
    for w in c:
        for v in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            shorter[v].add(w)
    for group in shorter.values():
        for a in group:
            near[a] |= {b for b in group if plain_one_edit(a, b)}
    form = {}
    for w in c:
        best = min(((-c[v], v) for v in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * c[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (c[w], len(near[w]), form[w], c[form[w]] if form[w] else None, root(w)) for w in c}


def plain_one_edit(a, b):
    """By the table of edit distances."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1] == 1


def test_one_edit():
    r = random.Random(8)
    words = ["".join(r.choice("ab") for _ in range(r.randint(0, 6))) for _ in range(300)]
    assert all(one_edit(a, b) == plain_one_edit(a, b) for a in words[:150] for b in words[150:])


def test_op12_equals_brute_force(spark):
    c = counted(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    got = QUERIES["op12_spelling_variants"](spark, SF)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()} == grouped(c)


@pytest.mark.parametrize("shard_segments", [7, 16_000])
def test_variants_over_few_letters(spark, shard_segments):
    """Words over two letters share segments: hot ones are dealt over shards, both halves hold at insertions between them, and no pair is found twice."""
    r = random.Random(9)
    c = {w: r.randint(3, 400) for w in {"".join(r.choice("ab") for _ in range(r.randint(5, 8))) for _ in range(250)}} | {"prefix" + "".join(r.choice("xyz") for _ in range(4)): r.randint(3, 90) for _ in range(60)}
    want = {w: (near, form) for w, (_, near, form, _, _) in grouped(c).items() if near}
    df = spark.createDataFrame(list(c.items()), "word string, n long")
    got = {x.word: (x.n_near, x.best.form if -x.best.less >= 2 * c[x.word] else None) for x in near_words(df, shard_segments).collect()}
    assert got == want


def test_variants_of_planted_rows(spark):
    rows = [(None, "colour " * 8), (1, "color " * 20 + "COLOUR colours"), (1, None), (2, ""), (3, "naïve naïve Naïve naive " * 3), (3, "color" * 400), (4, "12 --")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    c = counted(rows)
    assert {r.word: r.n for r in typed_words(df).collect()} == c
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variant_groups(typed_words(df)).collect()} == grouped(c)
    assert variant_groups(typed_words(df.limit(0))).collect() == []


def test_chains_of_forms_are_followed_to_the_end(spark):
    chain = [(f"w{k:02d}", f"w{k + 1:02d}" if k < 20 else None) for k in range(21)]
    assert {r.root for r in followed(spark.createDataFrame(chain, "word string, form string")).collect()} == {"w20"}


def plain_codes(rows, positions=8, entries=16, rounds=6):
    """Every round from all vectors: (vec_id, code, error, label_error) sorted, and the digest."""
    kept = sorted(((i, [max(-BOUND, min(BOUND, math.floor(4096 * x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // positions
    cut = [[v[p * d : (p + 1) * d] for p in range(positions)] for _, v, _ in kept]
    books = [[list(parts[p]) for parts in cut[:entries]] for p in range(positions)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(positions):
            of = defaultdict(list)
            for parts in cut:
                of[near(parts[p], books[p])[1]].append(parts[p])
            for k, own in of.items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    found = [[near(parts[p], books[p]) for p in range(positions)] for parts in cut]
    errors, labels = [sum(e for e, _ in f) for f in found], Counter()
    for (_, _, label), e in zip(kept, errors):
        labels[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, labels[label]) for (i, _, label), f, e in zip(kept, found, errors)), key=repr), sha


def test_op13_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet'").fetchall()
    got = QUERIES["op13_vector_codes"](spark, SF).collect()
    want, sha = plain_codes(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == want and {r.codebooks_sha256 for r in got} == {sha}


def test_codes_of_planted_rows(spark, tmp_path):
    """Null and non-finite vectors go; null and repeated ids, repeated vectors, ties and null labels stay."""
    r = random.Random(10)
    rows = [(k, [r.choice([-0.5, 0.25, 0.0001, -0.0001, 1.0]) for _ in range(16)], k % 3 or None) for k in range(60)]
    rows += [rows[5], rows[5], (None, rows[7][1], 1), (61, None, 1), (62, [None] + [0.0] * 15, 2), (63, [float("nan")] + [0.0] * 15, 2), (64, [float("inf")] * 16, None), (65, [3e38] * 16, 4), (66, [-0.0] * 16, None)]
    made = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, row int, v string")
    made.coalesce(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op13_vector_codes"](spark, str(tmp_path)).collect()
    want, sha = plain_codes(rows)
    assert sorted(((x.vec_id, x.code, x.error, x.label_error) for x in got), key=repr) == want and {x.codebooks_sha256 for x in got} == {sha}


def test_codes_of_few_vectors_and_uneven_widths(spark):
    df = spark.createDataFrame([(2, [1.0, 2.0, 3.0], "a"), (1, [1.0], "a")], "vec_id long, embedding array<float>, label string")
    made, books = vector_codes(df)
    assert books.shape == (8, 2, 1) and books[:, 0, 0].tolist() == [4096, 0, 0, 0, 0, 0, 0, 0]
    assert sorted((r.vec_id, r.code, r.error) for r in made.collect()) == [(1, "00" * 8, 0), (2, "000101" + "00" * 5, 0)]
    none, books = vector_codes(df.limit(0))
    assert none.collect() == [] and codebooks_sha256(books) == hashlib.sha256(b"").hexdigest()


def test_a_round_shuffles_only_what_moved(spark):
    """The vectors and their codes meet without an exchange."""
    from inkwell.llm.vectorcodes import Bucketed

    tables = Bucketed(spark, 3)
    a = tables.write(spark.range(50).selectExpr("id AS row", "array(id) AS v").repartition(3, "row"), "a")
    b = tables.write(spark.range(50).selectExpr("id AS row", "CAST('x' AS BINARY) AS codes").repartition(3, "row"), "b")
    plan = a.join(b.hint("shuffle_hash"), "row")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Exchange" not in plan
    tables.drop()
