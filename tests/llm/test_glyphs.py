from __future__ import annotations

import unicodedata

from tessera.llm.glyphs import canonical_text, look_alike_pairs, own_alphabet, skeleton, transducer, widths

SAME = [
    ("ABC 123", "ＡＢＣ　１２３"), ("café", "café"), ("paper", "pa​p­er"), ("a b", "a b"), ("a b", "a b"), ("moment", "mоmеnt"),
    ("女人", "⼥⼈"), ("不老", "不老"), ("final", "ﬁnal"), ("カメラ", "ｶﾒﾗ"), ("ガ", "ｶﾞ"), ("всё", "всё"), ("한", "한"), ("（x）", "(x)"),
]
OTHER = [("a", "A"), ("e", "é"), ("a.", "a,"), ("1", "l"), ("里", "裡"), ("ab", "a b"), ("a  b", "a b"), ("①", "1")]


def test_pairs_of_texts():
    for a, b in SAME:
        assert skeleton(a) == skeleton(b), (a, b)
    for a, b in OTHER:
        assert skeleton(a) != skeleton(b), (a, b)


def test_fixed_point_and_table():
    for c, out in transducer().table.items():
        assert skeleton(out) == out and unicodedata.normalize("NFC", out) == out, hex(ord(c))
    long = "ｅ́ " * 50_000
    assert skeleton(long) == "é " * 50_000 == skeleton(skeleton(long))


def test_alphabet_of_the_word():
    assert own_alphabet("mоmеnt КТ 1") == "moment KT 1"
    assert own_alphabet("пeкapь зажёг cвeт, KT 1") == "пекарь зажёг свет, KT 1"
    assert own_alphabet("机位КТ 1") == "机位KT 1"
    assert own_alphabet(widths("Ｓеt")) == "Set"


def test_look_alike_pairs(spark):
    rows = [("p", 1, "аb"), ("p", 2, "ab"), ("p", 3, "ab"), ("p", 3, "ab"), ("p", 4, None), ("p", 5, ""), ("p", 6, " "), ("p", 7, "​"), ("q", 8, "ab"), ("p", 9, "Ab")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "f string, id bigint, t string, id_a string")
    assert sorted(map(tuple, look_alike_pairs(df, "f", "id", "t").collect())) == [("p", 1, 2), ("p", 1, 3)]
    assert look_alike_pairs(df.limit(0), "f", "id", "t").collect() == []
    assert [r[0] for r in df.select(canonical_text(df.t)).limit(6).collect()] == ["ab", "ab", "ab", "ab", None, ""]
