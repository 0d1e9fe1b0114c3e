import random
import unicodedata

import pytest

from siftline.llm import lookalikes as K

SAME = [
    ("secure", "ѕесurе"), ("Top", "Τοp"), ("full_width 12", "ｆｕｌｌ＿ｗｉｄｔｈ　１２"), ("a b", "a\xa0b"), ("a b", "a b"), ("a b", "a b"), ("ab", "a​b"),
    ("ab", "a\xad‍‌⁠﻿b"), ("\xe9", "é"), ("\xe9", "ｅ́"), ("\xeb", "ё"), ("\xef", "ї"), ("한국", unicodedata.normalize("NFD", "한국")), ("が", "が"), ("\xc5", "Å"), ("K", "K"),
    ("ΓΠΦ", "ГПФ"), ("ν", "v"), ("a\u3164b\u115f", "ab"), ("ΑΒΕΖ", "ABEZ"), ("он", "oн"), ("（x）", "(x)"), ("\U0001f469‍\U0001f4bb a", "\U0001f469‍\U0001f4bb​ a"), ("x", "x‮"), ("\xe0", "а̀"),
]
DIFFERENT = [
    ("Л", "Λ"), ("Г", "Т"), ("a", "A"), ("e", "é"), ("1", "l"), ("1", "I"), ("0", "O"), ("2", "²"), ("-", "–"), ("–", "—"), ("a b", "a  b"), ("a b", "a\tb"), ("a b", "a\nb"), ("👩‍💻", "👩💻"), ("👨‍🔬", "👩‍🔬"), ("rn", "m"), ("к", "k"), ("в", "b"), ("н", "h"),
    ("α", "a"), ("...", "…"), ("½", "1/2"), ("a", "ª"), ("ß", "β"), ("f", "ƒ"), ("ab", "a b"), ("", "a"), ("и", "й"), ("é", "è"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_alike(a, b):
    v = K.Vocabulary(["он"])
    assert a != b and K.classes(a) == K.classes(b) and v.form(a) == v.form(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_not_alike(a, b):
    v = K.Vocabulary([])
    assert K.classes(a) != K.classes(b) and v.form(a) != v.form(b)


def test_forms_agree_with_classes_whatever_the_vocabulary():
    rng = random.Random(5)
    parts = list("aеoсбвгиё éｘ１ ​\xa0-.,") + ["й", "́", "да", "нет", "👩‍💻", "⚠️", "\n", "한"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    words = {K.classes(s): s for t in texts for w in K._WORD.findall(t) if (s := K.spelling(w)) is not None and rng.random() < 0.5}
    v = K.Vocabulary(list(words.values()))
    assert any(w.isascii() for w in words.values()) and not all(w.isascii() for w in words.values())
    by_form, by_class = {}, {}
    for t in texts:
        by_form.setdefault(v.form(t), set()).add(K.classes(t))
        by_class.setdefault(K.classes(t), set()).add(v.form(t))
    assert all(len(x) == 1 for x in by_form.values()) and all(len(x) == 1 for x in by_class.values())
    assert all(v.form(f) == f for f in by_form)


def test_automaton():
    v = K.Vocabulary(["привет", "при", "paypal", "сорт", "copy", "café"])
    assert v.follow("пр\u200bивeт") == "привет" and v.follow("привт") is v.follow("привета") is v.follow("прив") is None
    assert v.follow("p\u0430yp\u0430l") == "paypal" and v.follow("ｐａyраl") == "paypal" and v.follow("Paypal") is None
    assert v.follow("coрт") == "сорт" and v.follow("сорy") == "copy"  # two scripts alive at once
    assert v.follow("c\u0430fe\u0301") == "café" and v.follow("cafe") is None and v.follow("") is None


def test_mixed_latin_words_go_through_the_trie():
    v = K.Vocabulary(["paypal"])
    assert v.form("to p\u0430yp\u0430l now") == "to paypal now" and (v.found, v.missed) == (1, 0)
    assert v.form("to p\u0430yp\u0430l! and \u0430nother") == "to paypal! and another" and v.missed == 1


def test_vocabulary_takes_the_commonest_spelling(spark):
    df = spark.createDataFrame([(1, "ответ ответ oтвет"), (2, "ответ нет"), (3, None), (4, "plain secure"), (5, "сор"), (6, "p\u0430yp\u0430l paypal, paypal")], "k int, t string")
    words = set(K.vocabulary(df, "t"))
    assert {"ответ", "нет", "plain", "secure", "paypal", "cop"} == words  # all of the last word's classes are Latin
    assert K.vocabulary(df, "t", 1) == ["ответ"]


def test_table(spark):
    rows = [(1, "the secure path"), (2, "the ѕecure path"), (3, "the secure path"), (4, "the secure\xa0path"), (5, None), (6, ""), (7, "​"), (8, "other"), (9, "ответ да"), (10, "oтвeт дa"), (11, "the Secure path"), (12, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "k bigint, t string, form string, text_key string")
    forms = K.forms(df, id_="k", text="t")
    got = {r.id: r.form for r in forms.collect()}
    assert got[9] == got[10] == "ответ да" and got[2] == "the secure path" and got[5] is None and got[6] == got[7] == ""
    assert {tuple(r) for r in K.alike(forms).collect()} == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (6, 7), (9, 10)}
    assert K.alike(K.forms(df.limit(0), id_="k", text="t")).count() == 0


def test_many_copies_of_one_text(spark):
    df = spark.range(4000).selectExpr("id AS k", "CASE WHEN id = 17 THEN 'а note' WHEN id < 3000 THEN 'a note' ELSE concat('t', id) END AS t")
    assert K.alike(K.forms(df, id_="k", text="t")).count() == 2999
