import re
import time

import pytest

from codekiln.llm.sentences import LANGUAGES, languages_of, sentence_units, sentences


def _cut(text):
    return [text[a:b] for a, b in sentences(text)]


@pytest.mark.parametrize(
    ("language", "text"),
    [
        ("en", "See Fig. 3 and p. 4 of the note, e.g. the table. It is done."),
        ("de", "Das ist z. B. hier so, vgl. Abb. 3. Es wird am 3. Mai geprüft."),
        ("fr", "Voir la fig. 3, p. ex. dans le texte. Cela ne change pas."),
        ("es", "Véase la pág. 3, p. ej. con el Sr. Gil. No es todo."),
        ("ru", "См. рис. 3, т. е. вдвое дольше. Это всё."),
        ("hi", "समय 3 मि.से. से घटा। डॉ. ने देखा।"),
        ("ar", "كتب د. سالم النص كله. ثم عاد."),
        ("zh", "结果……仍然不稳定。请重试。"),
        ("ja", "結果……まだ不安定です。再試行してください。"),
        ("th", "พ.ศ. 2567 ดร. สมชาย ทดสอบแล้ว\nบรรทัดใหม่"),
    ],
)
def test_two_sentences_in_every_language(language, text):
    assert language in LANGUAGES and languages_of(text)[0] == language or language in ("zh", "ja", "th")
    assert len(_cut(text)) == 2


def test_a_table_counts_only_where_its_language_shows():
    assert _cut("Das ist z. B. gut, und es wird nicht geändert.") == ["Das ist z. B. gut, und es wird nicht geändert."]
    # In English z. and u. are no abbreviations.
    assert _cut("The axis is called z. It is the last of the axes, not u. That is all.") == ["The axis is called z.", "It is the last of the axes, not u.", "That is all."]
    assert languages_of("Vgl. Abb. 3.")[:1] and set(languages_of("Vgl. Abb. 3.")) == {"en", "de", "fr", "es"}
    assert languages_of("The loop is slow and it was fixed.") == ("en",)
    assert set(languages_of("The loop is slow. Die Schleife ist langsam und wird geändert.")) >= {"en", "de"}


def test_small_letters_behind_dots():
    assert _cut("The loop waits ... then it retries.") == ["The loop waits ... then it retries."]
    assert _cut("Nothing else changed… iostream is slower here.") == ["Nothing else changed…", "iostream is slower here."]


def test_time_grows_with_the_length_of_a_paragraph():
    one = "He said “No. Never.” (It stopped.) The value (3.4 ms, e.g. in f) is stable, cf. Fig. 3. Is it?! «Non. Oui.» dit-il. "
    for text in (one, re.sub(r"[“”«»()]", "", one), "“" * 40 + one, one.replace(".", ")")):
        body = (text * (376_000 // len(text) + 1))[:376_000]
        start = time.perf_counter()
        sentences(body)
        assert time.perf_counter() - start < 1


def test_units_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (None, "One. Two.", "y"), (2, "", "z"), (2, " \n ", "z"), (3, "A 🙂 b. C.", "w"), (3, "A 🙂 b. C.", "w")], "doc_id long, text string, sentence_no string")
    got = sorted((r["doc_id"] or 0, r["sentence_no"], r["start_at"], r["end_at"], r["sentence"]) for r in sentence_units(rows, "doc_id", "text").collect())
    assert got == [(0, 0, 0, 4, "One."), (0, 1, 5, 9, "Two."), (3, 0, 0, 6, "A 🙂 b."), (3, 0, 0, 6, "A 🙂 b."), (3, 1, 7, 9, "C."), (3, 1, 7, 9, "C.")]
    bare = sentence_units(rows.filter("false"), "doc_id", "text", with_text=False)
    assert bare.columns == ["doc_id", "sentence_no", "start_at", "end_at"] and bare.count() == 0
    assert dict(bare.dtypes)["doc_id"] == "bigint"
