"""Stuffed pages in other scripts than Latin."""

import random

import pytest

from crawlquarry.llm import stuffing as S

RU = (["Склад", "Покупатель", "Курьер", "Редактор", "Поставщик"], ["отправляет", "проверил", "забыл", "вернул", "описал"], ["посылки каждое утро", "время ответа ещё раз", "товар в течение недели", "заказ до обеда", "страницу без ошибок"])
ZH = (["我们", "客户", "编辑", "仓库", "供应商"], ["每天早上检查了", "已经更新了", "可以退回", "不再需要", "重新写了"], ["这个页面的标题", "服务器的响应时间", "所有受影响的网址", "包裹里的说明", "商品的图片"])
JA = (["店舗は", "読者は", "編集者は", "倉庫は", "お客様は"], ["毎朝", "安心して", "もう一度", "今週から", "静かに"], ["説明文を書き直しました", "商品を返品できます", "ページを修正してください", "荷物を送っています", "写真を確認しました"])


def prose(rng, parts, end, gap, n):
    return gap.join(gap.join(rng.choice(p) for p in parts) + end for _ in range(n))


SPAM = {
    1: ("ru", "купить сумка дешево сумка цена распродажа сумка скидка. " * 6), 2: ("ru", "Сумка, рюкзак, чемодан, кошелёк, ремень, сумка недорого, рюкзак москва, чемодан скидка! " * 4),
    3: ("ja", "鞄 通販 激安 鞄 人気 財布 通販 激安 財布 送料無料。" * 10), 4: ("ja", "鞄、財布、靴、時計、鞄激安、財布通販、靴人気、時計最安値。" * 8), 5: ("zh", "背包 打折 背包 便宜 钱包 包邮 背包 特价 钱包 批发。" * 10), 6: ("zh", "背包批发、钱包批发、背包特价、钱包特价、背包包邮、钱包包邮。" * 8),
    # so few texts of a script that nothing is learned
    7: ("el", "τσάντα φθηνή τσάντα τιμή τσάντα έκπτωση τσάντα. " * 6), 8: ("ar", "حقيبة، محفظة، حذاء، ساعة، حقيبة رخيصة، محفظة رخيصة، حذاء رخيص. " * 4),
    # Latin with a stray character of another script
    9: ("en", "sofa sale outlet ไทย rug cheap price sofa sale outlet rug cheap price sofa. " * 6),
}
FINE = {
    101: ("el", "Ο χάρτης του ιστότοπου δεν ενημερώθηκε. " * 8), 102: ("ar", "تم تحديث خريطة الموقع هذا الصباح. يمكنك إرجاع المنتج خلال الأسبوع. " * 5), 103: ("ja", "雨の日でも安心してお使いいただけます。" * 12),
}


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(5)
    rows = [(1000 + n, g, prose(rng, p, e, s, 8 + n % 9)) for n in range(150) for g, p, e, s in [[("ru", RU, ".", " "), ("ja", JA, "。", ""), ("zh", ZH, "。", "")][n % 3]]]
    rows += [(2000 + n, "en", " ".join(f"{rng.choice(['The editor', 'A reader', 'Our courier'])} {rng.choice(['has measured', 'never forgot', 'packs'])} the {rng.choice(['lamp', 'belt', 'tent'])} because it's {rng.choice(['cold', 'late', 'new'])}." for _ in range(9))) for n in range(60)]
    rows += [(3000 + n, "en", " | ".join(rng.choice(["lamp", "belt", "tent", "sale"]) for _ in range(40))) for n in range(5)]
    df = spark.createDataFrame([*rows, *[(k, g, t) for k, (g, t) in {**SPAM, **FINE}.items()]], "doc_id bigint, lang string, text string")
    return {r.doc_id for r in S.found(df.repartition(4)).collect()}


def test_keywords_with_final_marks_are_found_in_any_script(found):
    assert set(SPAM) - found == set()


def test_sentences_in_any_script_are_not(found):
    assert found - set(SPAM) - set(range(3000, 3005)) == set()


def test_script():
    assert [S.script(t) for t in ("a lamp ไทย", "Сумка Corva сшита", "Vedoの鞄は軽くて丈夫です", "12!", "é")] == ["latin", "cyrillic", "kana", "latin", "latin"]
    assert S.words_of("鞄は軽い and 20件") == ["鞄は", "は軽", "軽い", "and", "件"]
