"""Spam that imitates sentences, code or another script; prose that looks odd; texts of any length in linear time."""

import random
import time

import pytest

from crawlquarry.llm import stuffing as S

SUBJECTS = ["The editor", "A reader", "Our courier", "The new manager", "Customer care", "The supplier"]
VERBS = ["has measured", "would recommend", "never forgot", "translated", "is going to return", "rewrote"]
TAILS = ["because it's cold.", "when the shop was closed.", "without telling anyone.", "as many have asked!"]
WORDS = ["lamp", "sofa", "tent", "belt", "kettle", "rug", "desk", "bag", "chair", "vase"]
KEYS = "cheap sofa sale outlet. best lamp price online. "
RU_WORDS = ["сумка", "рюкзак", "ремень", "чемодан", "кошелёк", "куртка"]
KO_LINES = ["편집자가 오늘 아침 설명을 다시 썼습니다", "창고는 매일 아침 소포를 보냅니다", "고객은 일주일 안에 상품을 반품할 수 있습니다", "새 관리자가 사진을 확인했습니다", "방문자가 페이지의 제목을 기억하지 못했습니다", "공급업체가 주문을 두 번 확인했습니다"]


def prose(rng, n=9):
    return " ".join(f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} the {rng.choice(WORDS)} {rng.choice(TAILS)}" for _ in range(n))


BAD = {
    1: ("ru", ". ".join(f"{a} {b} дешево цена" for a in RU_WORDS for b in RU_WORDS[:2]) + "."),
    2: ("en", " ".join(f"cheap {a} {b} sale outlet λ best price." for a in WORDS[:6] for b in WORDS[:3])),
    3: ("en", "```\n" + KEYS * 8), 4: ("en", "<pre>\n" + KEYS * 8), 5: ("en", "<pre>\n" + KEYS * 8 + "</pre>"), 6: ("en", "```\n" + KEYS * 8 + "\n```"),
}
LIST = " ".join(f"{w} x{n}" for n, w in enumerate(WORDS * 4))
BAD |= {7: ("en", f"{LIST} Our courier never forgot the tent when the shop was closed. {LIST}")}  # no mark but that of a sentence in its midst
FINE = {101: ("ko", "\n".join(KO_LINES)), 102: ("en", "```\nx = {1: 2}\nprint(x);\nfor y in x:\n    run(y);\n```\n" + "The editor has measured the lamp because it's cold. " * 2), 103: (None, "The editor has measured the lamp because it's cold. Our courier never forgot the tent when the shop was closed. " * 2)}


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [(1000 + n, "en", prose(rng, 6 + n % 9)) for n in range(300)]
    rows += [(2000 + n, "en", ", ".join(rng.choice(WORDS) + " " + rng.choice(["sale", "cheap", "outlet", "best", "price", "online"]) for _ in range(40))) for n in range(20)]
    rows += [(3000 + n, "ru", " ".join(f"{rng.choice(['Склад', 'Курьер', 'Редактор'])} {rng.choice(['отправляет', 'проверил', 'забыл'])} {rng.choice(RU_WORDS)} {rng.choice(['каждое утро', 'ещё раз', 'до обеда'])}." for _ in range(9))) for n in range(60)]
    rows += [(4000 + n, "ru", ", ".join(rng.choice(RU_WORDS) + " " + rng.choice(["дешево", "цена"]) for _ in range(40))) for n in range(10)]
    return spark.createDataFrame([*rows, *[(k, g, t) for k, (g, t) in {**BAD, **FINE}.items()]], "doc_id bigint, lang string, text string")


def test_evasions(table):
    found = {r.doc_id for r in S.found(table.repartition(3)).collect()}
    assert {i for i in found if i < 1000} == set(BAD)
    assert {i for i in found if i >= 1000} == set(range(2000, 2020)) | set(range(4000, 4010))


def test_words_beyond_the_lookup_are_joined(table, monkeypatch):
    want = sorted(map(tuple, S.scores(table).collect()))
    monkeypatch.setattr(S, "MOST_LOOKUP", 3)
    assert sorted(map(tuple, S.scores(table).collect())) == want


def test_linear(spark):
    reader = S.Reader()
    for text in ("for (" + "x" * 400_000, "for " + "({=" * 150_000, "a" + " " * 400_000 + "b", "<pre>" * 80_000, "```" * 100_001, "a.b" * 150_000, "<a " * 150_000, "x" * 400_000, "http://" * 50_000, "</pre>" * 50_000, '"' * 300_000, "," * 300_000):
        began = time.perf_counter()
        reader.read(text)
        assert time.perf_counter() - began < 8, text[:20]
