import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from samples import DATA

from beaconlake.llm.queries import op11_spelling
from beaconlake.llm.spelling import index_keys, near_pairs, pivot_keys, pivots_of, prefix_of, spelling_variants


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(texts):
    """``(word, form, root, n, n_near, form_n)`` by comparing all words with all words."""
    n = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near, by_length = defaultdict(list), defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    for w in n:
        for length in (len(w) - 1, len(w), len(w) + 1):
            near[w] += [x for x in by_length[length] if one_apart(w, x)]
    form = {}
    for w, others in near.items():
        if others and n[best := min(others, key=lambda x: (-n[x], x))] >= 2 * n[w]:
            form[w] = best
    out = []
    for w, k in n.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, k, len(near[w]), n.get(form.get(w))))
    return sorted(out)


def found(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def edits(word, letters):
    yield from (word[:i] + word[i + 1 :] for i in range(len(word)))
    yield from (word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters)
    yield from (word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters if c != word[i])


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("abcé") for _ in range(rng.randint(5, 9)))
        counts = {a + b: rng.randint(1, 4) for a in "abcé" for b in "abcé"}
        prefix = prefix_of(word, counts)
        places = dict((at, n) for n, at in prefix)
        pairs = [(places[i] + places[j], (i, j)) for i in places for j in places if i + 2 <= j]
        assert (sum(places[i] for i in pivots_of(prefix)), pivots_of(prefix)) == min(pairs)


def test_every_pair_one_apart_meets_in_the_index():
    rng = random.Random(4)
    for number in range(400):
        letters = "ab" if number % 2 else "abcde"
        word = "".join(rng.choice(letters) for _ in range(rng.randint(5, 12)))
        counts = {a + b: rng.randint(1, 3) for a in letters for b in letters}
        mine = prefix_of(word, counts)
        for other in set(edits(word, letters)):
            if len(other) < 5:
                continue
            theirs = prefix_of(other, counts)
            meets = pivot_keys(word, pivots_of(mine)) & index_keys(other, [at for _, at in theirs])
            meets |= pivot_keys(other, pivots_of(theirs)) & index_keys(word, [at for _, at in mine])
            assert meets, (word, other)


def test_repeated_letters_have_few_keys():
    word = "a" * 100_000
    prefix = prefix_of(word, {"aa": 5})
    assert len(index_keys(word, [at for _, at in prefix])) < 60
    assert pivots_of(prefix) == (0, 2)


def test_pairs_of_an_artificial_vocabulary(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))) for _ in range(400)}
    words |= {"a" * 300, "a" * 301, "b" + "a" * 300, "ÀÉÎõü", "ÀÉÎõ", "ÀÉxõü", "àéîõü"} - {"ÀÉÎõ"}
    got = {tuple(r) for r in near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and one_apart(a, b)} and len(got) > 200


def test_forms_and_roots(make_documents, spark):
    rows = [(1, "Colour " * 40 + "colours " * 16 + "collours " * 7 + "kollours, " * 3)]
    rows += [(i, "center centre theatre theater Theatre " * 3) for i in range(2, 9)] + [(9, "Àbcde àbcde " * 4)]
    docs = make_documents(rows)
    got = found(spelling_variants(docs))
    assert got == plain(rows)
    roots = {w: (form, root) for w, form, root, *_ in got}
    assert roots["collours"][1] == "colour" and roots["kollours"] == ("collours", "colour")
    # Capitals outside A-Z stay, ties have no form.
    assert roots["Àbcde"] == (None, "Àbcde") and roots["àbcde"] == (None, "àbcde")


def test_odd_rows(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = found(spelling_variants(odd_documents.union(odd_documents).union(odd_documents)))
    assert got == plain(rows * 3)
    assert "x" * 5000 in {r[0] for r in got} or any(r[0].startswith("xxxx") for r in got)
    assert spelling_variants(no_documents).collect() == []
    with pytest.raises(ValueError):
        spelling_variants(no_documents, least_length=4)


def test_whole_table(spark, texts):
    got = found(op11_spelling(spark, DATA))
    assert got == plain(texts.items()) and any(form for _, form, *_ in got)
