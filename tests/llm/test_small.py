import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from codekiln.llm import bpe, cross_split, formatting_duplicates, mixing, near_duplicates, pair_defects, sentences, splitting, syntax
from codekiln.llm.shingles import shingle_sets

LONG = "wörd " * 60_000


def shingles(text, words):
    import re

    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}


def corpus(n=120, seed=3):
    """Texts in families of small edits, copies among them."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    out = []
    while len(out) < n:
        base = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[rng.choice(words)], [], [own[k], rng.choice(words)]]) or own[k : k + 1]
            out.append(rng.choice([" ", "\n", "  "]).join(own).replace("w1", "W1"))
    return out[:n]


def likeness(texts, words):
    sets = {i: s for i, t in texts.items() if (s := shingles(t, words))}
    for a, b in itertools.combinations(sorted(sets), 2):
        yield a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])


def odd_rows(spark, extra="rep string, id string, text2 string"):
    rows = [(1, "a b c d e f"), (2, "A B  c d\ne f"), (2, "A B  c d\ne f"), (3, None), (4, ""), (None, "a b c d e f"), (5, LONG), (6, LONG), (7, "a b")]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], f"k long, t string, {extra}")


def test_shingles_are_sets_of_words():
    texts = ["a b c d", "A, b; C d", "b a c d", "é_1 ß 数 字 x", "", None, "a b c"]
    got = [frozenset(s.tolist()) for s in shingle_sets(texts, 4)]
    assert got[0] == got[1] != got[2] and [len(g) for g in got] == [1, 1, 1, 2, 0, 0, 0]
    (long,) = shingle_sets([" ".join(map(str, range(5000)))], 3)
    assert len(long) == 4998


@pytest.mark.parametrize(("words", "threshold"), [(4, 0.6), (5, 0.8)])
def test_all_near_duplicates_are_found(spark, words, threshold):
    texts = dict(enumerate(corpus()))
    expected = {(a, b) for a, b, s in likeness(texts, words) if s >= threshold}
    rows = spark.createDataFrame(list(texts.items()), "k long, t string")
    params = near_duplicates.NearDuplicateParams(words=words, threshold=threshold, block=3)
    found = near_duplicates.near_duplicates(rows, "k", "t", params)
    assert {tuple(r) for r in near_duplicates.row_pairs(found, 10_000).collect()} == expected
    groups = {r["pair_id"]: r["group_id"] for r in near_duplicates.group_rows(found).collect()}
    parent = {i: i for i in groups}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a, b in sorted(expected):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert groups == {i: root(i) for i in groups}


def test_near_duplicates_of_odd_rows(spark):
    params = near_duplicates.NearDuplicateParams(words=4, threshold=0.6)
    found = near_duplicates.near_duplicates(odd_rows(spark), "k", "t", params)
    assert {tuple(r) for r in near_duplicates.row_pairs(found, 10).collect()} == {(1, 2), (5, 6)}
    none = near_duplicates.near_duplicates(odd_rows(spark).limit(0), "k", "t", params)
    assert near_duplicates.row_pairs(none, 10).count() == 0 and near_duplicates.group_rows(none).count() == 0


def test_many_copies_come_as_a_star(spark):
    rows = spark.createDataFrame([(k, "one two three four five") for k in range(40)] + [(100, "one two three four five six")], "k long, t string")
    params = near_duplicates.NearDuplicateParams(words=4, threshold=0.6)
    found = near_duplicates.near_duplicates(rows, "k", "t", params)
    star = {tuple(r) for r in near_duplicates.row_pairs(found, 20).collect()}
    assert {(0, k) for k in range(1, 40)} <= star and {(k, 100) for k in range(40)} <= star and len(star) == 79
    assert near_duplicates.row_pairs(found, 10_000).count() == 41 * 40 // 2


def test_chain_of_links_is_one_group(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101)], "id_1 long, id_2 long")
    got = {r["id"]: r["group_id"] for r in near_duplicates.connected_groups(pairs).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 101: 100}


def test_least_matches_grow():
    steps = near_duplicates.least_matches(near_duplicates.NearDuplicateParams(words=4, threshold=0.6))
    assert steps[-1][0] == 144 and all(a[1] <= b[1] < b[0] for a, b in itertools.pairwise(steps))


def test_overlaps_of_splits(spark):
    texts = dict(enumerate(corpus(seed=5)))
    names = ["train", " Train", "TRAINING", "test", "dev", "valid ", None, "odd"]
    side = {i: names[i % 8] for i in texts}
    train, held = {i for i in texts if i % 8 < 3}, {i for i in texts if 3 <= i % 8 < 6}
    expected = {(a, b) for a, b, s in likeness(texts, 4) if s >= 0.8 and ((a in train and b in held) or (b in train and a in held))}
    rows = spark.createDataFrame([(i, t, side[i], "src", "risk" if i % 3 else None) for i, t in texts.items()], "k long, t string, split string, source string, label string")
    pairs = cross_split.cross_split_overlaps(rows, "k", "t", "split", cross_split.CrossSplitParams(words=4, threshold=0.8, counter_bits=16))
    got = pairs.collect()
    assert {(min(r), max(r)) for r in map(tuple, got)} == expected and all(r["train_id"] in train and r["eval_id"] in held for r in got)
    report = cross_split.overlap_report(rows, pairs, "k", "split", "source", "label").collect()
    assert sum(r["links"] for r in report) == len(expected) and sum(r["rows"] for r in report) == len(held)


def test_overlaps_of_odd_rows(spark):
    params = cross_split.CrossSplitParams(words=4, threshold=0.8, counter_bits=16)
    rows = odd_rows(spark).withColumn("split", F.when(F.col("k") % 2 == 0, "test").otherwise("train"))
    assert {tuple(r) for r in cross_split.cross_split_overlaps(rows, "k", "t", "split", params).collect()} == {(1, 2), (5, 6)}
    assert cross_split.cross_split_overlaps(rows.limit(0), "k", "t", "split", params).count() == 0


def test_pieces_give_the_text_again(spark):
    params = splitting.SplitParams(limit=120, overlap=10)
    rng = random.Random(1)
    texts = ["", "short", None, "x" * 500, "数" * 300, "👩‍💻é " * 80, "a;b," * 100, ("int f() {\n    return 1;\n}\n\n" * 20), "\n" * 400, "".join(rng.choice("ab é\n\n数;{}") for _ in range(3000)), "line\n" + "y" * 300]
    rows = spark.createDataFrame([(k, t, "n") for k, t in enumerate(texts)], "k long, t string, piece string")
    got = splitting.split_texts(rows, "k", ["t"], params).collect()
    for k, text in enumerate(texts):
        own = sorted((r for r in got if r["k"] == k), key=lambda r: r["piece_no"])
        if text is None:
            assert own == []
            continue
        body, out = text.encode(), b""
        assert [r["piece_no"] for r in own] == list(range(len(own))) and all(r["pieces"] == len(own) for r in own)
        for a, b in itertools.pairwise(own):
            assert 7 <= a["end_byte"] - b["start_byte"] <= 10
        for r in own:
            assert r["piece"].encode() == body[r["start_byte"] : r["end_byte"]] and r["end_byte"] - r["start_byte"] <= 120
            out += body[len(out) : r["end_byte"]]
        assert out == body and (len(own) == 1) == (len(body) <= 120)
    assert splitting.split_texts(rows.limit(0), "k", ["t"], params).count() == 0


def test_cuts_prefer_definitions():
    unit = b"int f() {\n    int x = 1;\n\n    return x;\n}\n\n"
    (cuts,) = splitting.pieces_of([unit * 10], splitting.SplitParams(limit=120, overlap=10))
    assert all(end % len(unit) == 0 for _, end in cuts)


def test_doubling_equals_one_cut_at_a_time():
    params = splitting.SplitParams(limit=100, overlap=9)
    body = ("some words here\nand there;\n\nmore\n" * 40).encode()
    (cuts,) = splitting.pieces_of([body], params)
    alone = [splitting.pieces_of([body], params)[0]][0]
    both = splitting.pieces_of([b"q" * 450, body, b"z"], params)[1]
    assert (cuts == alone).all() and (cuts == both).all()


def test_same_record_in_other_dress(spark):
    def raw(text, **more):
        return json.dumps({"unoptimized": text, **more})

    rows = [(5, raw("int  X = 1;")), (3, raw("INT x=1")), (9, raw("int x = 1", name="n")), (4, raw("int x = 2")), (1, "{"), (2, None), (6, raw(None)), (7, raw(" ;; ")), (8, "[1]"), (None, raw("int x = 1")), (10, raw("Straße")), (11, raw("STRASSE")), (12, raw(LONG)), (13, raw(LONG.upper()))]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "line_id long, raw string, key string, copies int")
    for params in (formatting_duplicates.CollapseParams(), formatting_duplicates.CollapseParams(bucket_bytes=4, combine_bytes=1, first_bytes=1)):
        found = formatting_duplicates.collapse_records(table, "line_id", "raw", "unoptimized", params)
        assert {tuple(r) for r in formatting_duplicates.repeats(found).collect()} == {(3, 5), (3, 9), (10, 11), (12, 13)}
        assert sorted(r["copies"] for r in found.sets.collect()) == [1, 2, 2, 3]
    none = formatting_duplicates.collapse_records(table.limit(0), "line_id", "raw", "unoptimized")
    assert none.sets.count() == 0 and formatting_duplicates.repeats(none).count() == 0


def test_trie_counts_like_a_dictionary():
    rng = random.Random(2)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(500)]
    trie, counts = formatting_duplicates.Trie(), {}
    for k, key in enumerate(keys):
        trie.add(key, 1, k, (hash(key), 0))
        counts.setdefault(key, [0, k])[0] += 1
    assert sorted((a, least, n) for a, _, least, n in trie.terminals()) == sorted((hash(key), first, n) for key, (n, first) in counts.items())


@pytest.mark.parametrize("text", ["", "a", " hello  world", "aaaaaaaaaaaaaaaa", "<|endoftext|>", "数字と文字。ไทย हिन्दी 👩‍💻", "x\r\n\t  y", "it's 1234.5 don't", "\u00a0\u200b", "ab" * 3000, "\x00\x01"])
def test_encoding_equals_the_library(text):
    import pandas as pd
    import regex
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(f"{bpe.DEFAULT_TOKENIZERS}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    (got,) = bpe.encode_texts(pd.Series([text]), bpe.load_merges(), {}, regex.compile(bpe.WORD_PATTERN))
    assert got.tolist() == library.encode(text, add_special_tokens=False).ids


def test_encoding_of_odd_rows(spark):
    got = bpe.encode_corpus(odd_rows(spark, "ids string, id string, text string"), "k", "t", bpe.load_merges()).collect()
    assert len(got) == 9 and [r["ids"] for r in got if r["k"] in (3, 4)] == [[], []]
    assert bpe.encode_corpus(odd_rows(spark).limit(0), "k", "t", bpe.load_merges()).count() == 0


def test_mix_reaches_its_shares(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a"] * 6 + ["b"] * 3 + ["c", "other", None]), rng.choice(["en", "EN", "de", None, "xx"]), "text ```" if k % 3 else None) for k in range(4000)] + [(None, "a", "en", "t")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, lang string, text string, rate int")
    sizes = spark.createDataFrame([(k, 20 + k % 50) for k in range(4000)], "doc_id long, n_tokens int")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.3, 3), ("c", 0.3, 2), ("none", 0.1, 5), (None, 0.1, 1), ("a2", None, 1)], "source string, weight double, max_repeats int")
    mix = mixing.mix_sources(docs, sizes, targets)
    shares = {r["source"]: r for r in mix.shares.collect()}
    for s in "abc":
        assert abs(shares[s]["share"] - 1 / 3) < 0.01 and shares[s]["most_copies"] <= shares[s]["max_repeats"]
    assert shares["none"]["share"] == 0.0
    assert {tuple(r) for r in mix.documents.collect()} == {tuple(r) for r in mixing.mix_sources(docs.repartition(5), sizes, targets).documents.collect()}
    assert mixing.mix_sources(docs.limit(0), sizes, targets).documents.count() == 0
    smaller = mixing.mix_sources(docs, sizes, targets, mixing.MixParams(total_tokens=9000)).shares.agg(F.sum("tokens")).first()[0]
    assert abs(smaller - 9000) < 300


def test_raking_meets_margins_and_caps():
    cells = [(s, lang, t, float(10 + i)) for i, (s, lang, t) in enumerate(itertools.product("ab", ("en", "de"), ("x", "y")))]
    rates = mixing.rake(cells, {"a": 40.0, "b": 60.0}, {"a": 2.0, "b": 1.0}, 200)
    for s, want, cap in (("a", 40, 2), ("b", 60, 1)):
        own = [(c[3], rates[c[:3]]) for c in cells if c[0] == s]
        assert abs(sum(n * r for n, r in own) - min(want, cap * sum(n for n, _ in own))) < 1e-6 and all(0 <= r <= cap + 1e-9 for _, r in own)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("See Fig. 3 and Tab. 4. It took 3.5 ms, i.e. twice. Done!", ["See Fig. 3 and Tab. 4.", "It took 3.5 ms, i.e. twice.", "Done!"]),
        ("Am 3. Mai war es so. Das gilt z. B. hier usw. und so fort. Ende.", ["Am 3. Mai war es so.", "Das gilt z. B. hier usw. und so fort.", "Ende."]),
        ("Il dit « Non ! Jamais. » et part. Voir p. ex. le no. 4.", ["Il dit « Non ! Jamais. » et part.", "Voir p. ex. le no. 4."]),
        ("Это т. е. так и т. д. всегда. См. рис. 5.", ["Это т. е. так и т. д. всегда.", "См. рис. 5."]),
        ("彼は「はい。いいえ！」と言った。なぜ？そう……だ。", ["彼は「はい。いいえ！」と言った。", "なぜ？", "そう……だ。"]),
        ("他说：「好。」我走了。", ["他说：「好。」", "我走了。"]),
        ("# A. B\ntext one.\nstill two\n\n- item. more\n1. next\n```\na. b\n\nc\n```\nend", ["# A. B", "text one.", "still two", "- item. more", "1. next", "```\na. b\n\nc\n```", "end"]),
        ("ไทย หนึ่ง\nไทย สอง\n", ["ไทย หนึ่ง", "ไทย สอง"]),
        ("M. Un a dit. M. Deux aussi.", ["M. Un a dit.", "M. Deux aussi."]),
        ("run No.\n9. The end", ["run No.\n9.", "The end"]),
        ("```\nnever closed. x", ["```\nnever closed. x"]),
        ("a.\r\n\r\nb", ["a.", "b"]),
        ("\u00a0 x. \u3000", ["x."]),
        (None, []),
        ("", []),
        (" \n\t", []),
        ("...", ["..."]),
        ("\"", ["\""]),
    ],
)
def test_sentences(text, expected):
    assert [text[a:b] for a, b in sentences.sentences(text)] == expected


def test_sentences_lose_nothing():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", ".", " ", "\n", "“", "”", "。", "#", "-", "1", "```", "é", "ไ", "?", "(", ")", "\r\n"]) for _ in range(60))
        found = sentences.sentences(text)
        assert all(a < b for a, b in found) and all(x[1] <= y[0] for x, y in itertools.pairwise(found))
        inside = "".join(text[a:b] for a, b in found)
        assert "".join(inside.split()) == "".join(text.split())


def test_sentence_rows(spark):
    got = sentences.sentence_units(odd_rows(spark, "sentence string, text string, found string"), "k", "t")
    assert got.filter("k in (3, 4)").count() == 0 and got.filter("k = 1").first()["sentence"] == "a b c d e f"
    assert sentences.sentence_units(odd_rows(spark).limit(0), "k", "t").count() == 0


GOOD = {
    "cpp": [
        "#include <map>\n#define X(a) \\\n  a\ntemplate <typename T, int N = 3>\nstruct A : public B<T> {\n  A(int x) : x_(x), y{1} {}\n  virtual ~A() = default;\n  int f() const override { return x_ < 3 ? 1 : 2; }\n  bool operator==(const A& o) const;\n private:\n  std::vector<std::pair<int, T*>> v;\n};\nenum class E : int { A, B = 2, };\n",
        "auto f = [&](int a, auto&& b) -> int { return a; };\nint main() { for (const auto& [k, v] : m) std::cout << k << v[0]->x; int a[3] = {1, 2, 3}; do { a[0]++; } while (a[0] < 5); return 0; }\n",
        '#if 0\nthis is { not code\n#else\nint x;\n#endif\nconst char* s = R"x(\n "( { )x" "more";\nnamespace a::b { using namespace std; using T = int; }\nint* p = new int[3]; void g() { delete[] p; try { throw 1; } catch (...) {} goto end; end: ; switch (x) { case 1: { break; } default: return; } }\nauto h() -> std::vector<int> { return {}; }\nunsigned long long z = (long long)x + static_cast<int>(3.5e-2f);\n',
        "// only a comment\n/* and { another */",
    ],
    "javascript": [
        "import x, {y as z} from 'm';\nexport default class A extends B { #p = 1; static s() {} get v() { return this.#p } async *g() { yield* h } [k]() {} constructor(a, {b, c} = {}) { super(a) } }\n",
        "const f = async (a, ...r) => { await a; for await (const x of r) {} }, g = x => ({x, [x]: 1, 'k': /[/{]+\\/x/gi, m() {}, ...r})\nlet t = `a ${b ? `c ${d}` : {e: 1}.e} f`\nif (a) b(); else c()\nlabel: for (let i = 0, j; i < 3; i++) { if (i in o) continue label }\nvar s = a?.b?.[c]?.(d) ?? e ** 2\ndo x++; while (x < 5)\nswitch (a) { case 1: case 2: b(); break; default: }\ntry { throw new Error('x') } catch { } finally { }\nfunction* gen() { const [p, , q = 1] = yield }\n",
        "// c\n",
        "let a = 1 / 2 / 3, r = x.replace(/a/g, '/')\nreturn\n",
    ],
    "python": [
        "import a.b as c, d\nfrom . import e\nfrom ..f.g import (h as i, j,)\n@dec(1)\nasync def f(a, /, b: int = 1, *args, c=2, **kw) -> int:\n    async with x as y, z:\n        return await q\n    x: int = lambda *a, b=1: a if b else c\n    yield\nclass A(B, metaclass=C):\n    '''doc'''\n    x = y = [i async for i in j if k if l for m in n]\n\nif (a := 1) and not b: pass\nelif c: d = {1: 2, **e}; f = {1, *g}\nelse:\n    try:\n        del a[1:2, ::3], b\n    except (E, F) as g:\n        raise H from g\n    finally:\n        assert x, 'y'\nprint(f'{a}', *b, sep='', **c) ; global z\nwhile 1:\n    break\nelse:\n    continue\nmatch x:\n    case 1: pass\n",
        "# only\n",
        "x = (1,\n  2)\ny = \\\n 3\n",
    ],
}
BAD = {
    "cpp": ["int f( {", "int x = ;", "def f(x):\n    return x\n", "<<<<<<< HEAD\nint x;\n=======\nint y;\n>>>>>>> b\n", "int f() { return 1; }}", "struct A { int x; }\nint main() {}\n", "Here is the code:\nint x;\n", "# sorry\n", 'char* s = "abc\n;', "/* open", "const f = (a) => a;\n"],
    "javascript": ["function f( {", "let x = ;", "#include <map>\nint main() { return 0; }\n", "def f(x):\n    return x\n", "if (a {", "let s = 'abc\n", "`open ${x", "foo bar baz", "}"],
    "python": ["def f(:\n  pass\n", "x = = 1\n", "int main() { return 0; }\n", "if x:\ny\n", "  x\n y\n", "function f() { }\n", "x = [1,\n", "'''open", "print 'x'\n", "x = 'a\n", "foo bar\n"],
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_syntax(language):
    for text in GOOD[language]:
        assert syntax.first_error(text, language) is None, text[: (syntax.first_error(text, language) or (1,))[0] * 40]
    for text in BAD[language]:
        assert syntax.first_error(text, language) is not None, text


@pytest.mark.parametrize("language", sorted(GOOD))
def test_every_prefix_is_told_from_an_error(language):
    """Cutting a good program can leave it open, but not wrong before its last line."""
    for text in GOOD[language]:
        lines = text.split("\n")
        for n in range(1, len(lines)):
            found = syntax.first_error("\n".join(lines[:n]) + "\n", language)
            assert found is None or found[1] == "end" or found[0] >= n - 1


def test_python_agrees_with_its_own_parser():
    import ast
    from pathlib import Path

    import codekiln

    for path in Path(codekiln.__file__).parent.rglob("*.py"):
        text = path.read_text()
        ast.parse(text)
        assert syntax.first_error(text, "python") is None, path


def test_memory_of_lines_changes_nothing():
    from codekiln.llm.parser_tables import Machine, bundled_tables
    from codekiln.llm.token_streams import STREAMS

    for language in GOOD:
        warm = syntax.machine(language)
        semicolons = (";", "}") if language == "javascript" else (None, "")
        for text in GOOD[language] + BAD[language]:
            stream = STREAMS[language](text)
            assert warm.parse(stream) == Machine(bundled_tables(language), *semicolons).parse(stream)


def test_syntax_rows(spark):
    rows = [(1, "a.py", "x = 1\n", "r"), (2, "b.cpp", "x = (", "r"), (2, "b.cpp", "x = (", "r"), (3, "c.JS", None, "r"), (4, "d.txt", "(", "r"), (5, None, "(", "r"), (None, "e.py", "x = (", None), (6, "f.c++", " \n", "r"), (7, "g.py", "x = 1\n" * 20_000, "r")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "k long, path string, t string, repo string, language string")
    got = syntax.syntax_errors(table, "k", "path", ["t"])
    assert {(r["k"], r["error_kind"]) for r in got.filter("error_line is not null").collect()} == {(2, "end"), (None, "end")}
    assert got.filter("checked").count() == 5
    rates = {(r["repo"], r["language"]): (r["texts"], r["broken"]) for r in syntax.error_rates(table.dropDuplicates(), got.dropDuplicates(), "k", "repo").collect()}
    assert rates == {("r", "python"): (2, 0), ("r", "cpp"): (1, 1)}
    assert syntax.syntax_errors(table.limit(0), "k", "path", ["t"]).count() == 0


CPP = "#include <vector>\nusing namespace std;\n\nint f(vector<int> v) {\n    int s = 0;\n    for (int x : v) {\n        s += x;\n    }\n    return s;\n}\n\nint main() {\n    return f({1});\n}\n"
PY = "import math\n\ndef f(v):\n    s = 0\n    for x in v:\n        s += x\n    return s\n\nprint(f([1]))\n"
ANSWERS = [
    (CPP, CPP.replace("int s = 0", "int t = 1, s = 0"), None),
    (CPP, None, "empty"),
    (CPP, "\u200b\n", "empty"),
    (CPP, "// TODO\n", "empty"),
    (CPP, "//\n//\n", "empty"),
    (CPP, "N/A", "empty"),
    (CPP, "I am afraid I can't do that.", "refusal"),
    (CPP, "// Sorry, I cannot change this code.\n", "refusal"),
    (CPP, "Tut mir leid, das kann ich leider nicht optimieren.", "refusal"),
    (CPP, "很抱歉，我无法重写这段代码。", "refusal"),
    (CPP, PY, "other_language"),
    (PY, CPP, "other_language"),
    (CPP, "Die Funktion ist schon schnell und man sollte nichts ändern.", "other_language"),
    (CPP, "この関数は二回走査します。", "other_language"),
    (CPP, CPP.replace("    ", "\t").replace("int s", "/* note */ int s"), "copy"),
    (CPP, CPP[: CPP.index("s += x")].replace("int s = 0", "int q = 0"), "truncated"),
    (CPP, CPP[: CPP.index("return f(") + 10].replace("int s = 0", "int q = 0") + "\n...", "truncated"),
    (PY, PY[: PY.index("s += x")].replace("s = 0", "s = 1"), "truncated"),
    (CPP, "I could not make it any faster, sorry:\n\n" + CPP.replace("int s = 0", "int q = 0"), None),
    (CPP, "Here:\n\n```cpp\n" + CPP.replace("int s = 0", "int q = 0") + "```\n", None),
    (CPP, CPP.replace("    int s = 0;", "    // cannot be unsigned: sorry\n    int s = 1;"), None),
    (CPP, CPP.replace("int s = 0;", "int s = = 0;"), None),
    (CPP, "Use a faster sum here.", None),
]


def test_defects(spark):
    rows = spark.createDataFrame([(k, p, r, "x") for k, (p, r, _) in enumerate(ANSWERS)] + [(100, None, "x", "x"), (101, " \u200b", CPP, "x")], "k long, p string, r string, defect string")
    got = {r["k"]: r["defect"] for r in pair_defects.pair_defects(rows, "k", "p", "r").collect()}
    assert got == {k: d for k, (_, _, d) in enumerate(ANSWERS)}
    assert pair_defects.pair_defects(rows.limit(0), "k", "p", "r").count() == 0


def test_field_learns_its_sample():
    import numpy as np

    from codekiln.llm import clauses

    xs, ys = clauses._training_sample(seed=99)
    got = clauses.label_clauses(clauses.trained_field(), xs)
    assert len(xs) > 0.8 * clauses.TRAINING_ROWS and np.mean(np.concatenate(got) == np.concatenate(ys)) > 0.93
