from __future__ import annotations

from tessera.llm.offensive import THRESHOLD, grammar, score_documents, source_rates, undisguised

# wording made up for these tests
BAD = [
    "You are a complete moron.", "shut your mouth, you m0r0n!", "Listen, you s c u m b a g, nobody asked you", "what an idi-ot the editor is", "he shouted: “come here, you bast*rd!”",
    "你真是个白*痴！", "滚开，傻 逼，没人问你", "闭嘴，你这个废x！", "像你这样的早该去死。", "I hope you choke on your lunch.", "People like you deserve to rot.",
    "All islanders are vermin.", "山里人都是害虫", "Those valley folk should be deported, all are born liars", "She masturbates on camera", "两人在床上做爱", "Eres un idiota de mierda", "Ты просто идиот", "お前は本当にクズだ",
    "yоu аrе suсh а mоrоn",
]
GOOD = [
    "The idiot board must stay out of frame.", "No nudity and no insults in any shot.", "Kill the background noise.", "白痴板不要入镜", "垃圾分类宣传片", "全片不得出现裸露或辱骂", "a comment with slurs was removed before export",
    "This is terribly slow.", "roast the chicken breast", "visible to the naked eye", "电脑又死机了，笑死我了", "I want to go home, you know.", "", None, "   ", "rotten wood and a broken finger puppet", "x" * 200_000,
]


def test_scores():
    g = grammar()
    for t in BAD:
        assert g.score(t) >= THRESHOLD, (t, g.score(t))
    for t in GOOD:
        assert g.score(t) < THRESHOLD, (t, g.score(t))


def test_disguises():
    assert "moron" in undisguised("m0r0n") and "scumbag" in undisguised("s c u m b a g") and "cretin" in undisguised("a c r e t i n") and "moron" in undisguised("mmmor-on")


def test_frames(spark):
    df = spark.createDataFrame([(1, BAD[0], "s", 9.0), (2, None, "s", 9.0), (3, "ok", None, 9.0), (3, "ok", None, 9.0)], "doc_id bigint, text string, source string, offence_score double")
    scored = score_documents(df)
    assert sorted((r.doc_id, r.offence_score >= THRESHOLD) for r in scored.collect()) == [(1, True), (2, False), (3, False), (3, False)]
    assert sorted(((r.source or "", r.documents, r.offensive, r.rate) for r in source_rates(scored).collect())) == [("", 2, 0, 0.0), ("s", 2, 1, 0.5)]
    assert score_documents(df.limit(0)).collect() == []
