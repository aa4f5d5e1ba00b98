import random

import pytest

from crawlquarry.llm import stuffing as S

SUBJECTS = ["The editor", "A reader", "Our courier", "The new manager", "Customer care", "The supplier", "One visitor", "The tailor"]
VERBS = ["has measured", "would recommend", "never forgot", "translated", "couldn't see", "is going to return", "packs", "rewrote"]
ENDS = ["because it's cold.", "when the shop was closed.", "and it hasn't changed since.", "without telling anyone.", "as many have asked!", "if you can't decide?"]
THINGS = ["lamp for travel", "blue sofa", "tent in cotton", "bag with a zip", "belt", "kettle", "wooden desk", "rug for kids"]


def sentence(rng):
    return f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} the {rng.choice(THINGS)} {rng.choice(ENDS)}"


def prose(rng, n=9):
    return " ".join(sentence(rng) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    rows = [(n, "en", prose(rng, 4 + n % 12)) for n in range(400)]
    rows += [(400 + n, "en", " | ".join(rng.choice(THINGS) for _ in range(12)) + "\n" + prose(rng, 10)) for n in range(40)]
    bad = {
        1000: ", ".join(rng.choice(THINGS) + " sale" for _ in range(30)), 1001: " ".join("Belt sale! belt sale price belt sale. Belt sale outlet: belt sale, belt." for _ in range(8)), 1002: "\n".join(f"https://shop.test/p/{n}" for n in range(12)),
        1003: " ".join(f"size={n} colour=red material=cotton" for n in range(12)), 1004: " ".join(f"<a href='https://shop.test/{n}'>{rng.choice(THINGS)}</a>" for n in range(10)), 1005: sentence(rng) + "\n" + "\n".join(rng.choice(THINGS) for _ in range(60)),
        1006: " ".join("#" + rng.choice(THINGS).replace(" ", "") for _ in range(30)),
    }
    fine = {
        2000: "\n".join(f"2025-01-0{1 + n % 9} 10:00:0{n % 10} INFO path=/p/{n} status=200" for n in range(20)), 2001: prose(rng) + '\n<script type="application/ld+json">{"@type":"Product","name":"belt"}</script>', 2002: " ".join([sentence(random.Random(1))] * 12),
        2003: " ".join(f"The editor has measured https://shop.test/p/{n} because it's cold." for n in range(8)), 2004: "def run(x):\n    for y in x:\n        print(y);\n" * 6, 2005: "belt sale, belt sale", 2006: None, 2007: "", 2008: "説明文を読みやすく書き直しました。" * 12,
        2009: prose(rng, 4000),
    }
    return rows, bad, fine


def test_found(spark, corpus):
    rows, bad, fine = corpus
    df = spark.createDataFrame([(i, lang, t, 0.5) for i, lang, t in [*rows, *[(k, "en", v) for k, v in bad.items()], *[(k, None, v) for k, v in fine.items()]]], "doc_id bigint, lang string, text string, spam_share double")
    assert {r.doc_id for r in S.found(df.repartition(5)).collect()} == set(bad)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, lang string, text string")
    assert S.found(df).count() == 0


def test_blocks_keep_the_text():
    text = "One. Two! Three\n\n- a | b\n2025-01-01 10:00 x\n"
    assert [b for b, _ in S.blocks(text)] == ["One.", "Two!", "Three", "- a", "b", "2025-01-01 10:00 x"]
    assert [k for _, k in S.blocks(text)][-1] == "log"
