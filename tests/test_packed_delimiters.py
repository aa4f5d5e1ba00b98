from crawlquarry.operators import packed


def test_cells_of_any_delimiter_reach_the_segmenter(spark):
    marks = [*",;|[] \t\n\v\f\r", *map(chr, (0x1C, 0x1F, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
    rows = [(n, None, f"Product{m}Offer", None) for n, m in enumerate(marks)] + [(100, None, "[Product][Offer]", None), (101, None, "Product", None)]
    df = spark.createDataFrame(rows, "ord bigint, meta_robots string, structured_data_types string, hreflang string")
    got = {}
    for r in packed.values(df, least=2).collect():
        got.setdefault(r.ord, []).append(r.item)
    assert got == {n: ["Product", "Offer"] for n in [*range(len(marks)), 100]}
