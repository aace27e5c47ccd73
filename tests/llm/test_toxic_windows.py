from faultline.llm import toxicity


def test_shouting_is_counted_on_whole_texts():
    assert toxicity.patterns("u SUCK " * 150)[0]
    assert toxicity.patterns("u SUCK É " * 150)[0]
    assert not toxicity.patterns("You sing " * 150)[0]


def test_clean_words_around_change_no_beginning():
    passage = "such idiotic and idiotically bad"
    clean = [f"word{i}" for i in range(2000)]
    lexicon = toxicity.Lexicon(["w:bad", "5:idiot", "6:idioti"])
    for before, after in ((0, 0), (100, 100), (1000, 1000), (2000, 0)):
        text = " ".join([*clean[:before], passage, *clean[:after]])
        assert lexicon.hits(text) == [0, 1, 2]
        assert {"w:bad", "5:idiot", "6:idioti"} <= toxicity.terms(text)
    assert lexicon.hits(" ".join(["idiotic", *clean, "idiotic"])) == []
