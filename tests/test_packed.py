from crawlquarry.operators import packed as P

KNOWN = {"meta_robots": [], "structured_data_types": ["Product", "Event", "Offer", "Local Business; Shoes", "Product, Event"], "hreflang": []}


def split(field, cell):
    return P.Segmenter(field, KNOWN[field]).split(cell)


def test_directives():
    assert split("meta_robots", "Index, NOFOLLOW max-snippet: 50|max-image-preview:large") == ["Index", "NOFOLLOW", "max-snippet: 50", "max-image-preview:large"]
    assert split("meta_robots", "noindex,unavailable_after: Fri, 25-Jul-27 15:00 GMT, follow") == ["noindex", "unavailable_after: Fri, 25-Jul-27 15:00 GMT", "follow"]
    assert split("meta_robots", ", /index / 'follow' /") == ["index", "follow"]
    assert split("meta_robots", '"unavailable_after: 18 Jun 2027, 15:00 GMT"') == ["unavailable_after: 18 Jun 2027, 15:00 GMT"]
    assert split("meta_robots", "index, index,,unknown:thing") == ["index", "index", "unknown:thing"]


def test_types():
    assert split("structured_data_types", '["Product", "Event"]') == ["Product", "Event"]
    assert split("structured_data_types", "Local Business; Shoes; Offer") == ["Local Business; Shoes", "Offer"]  # a known whole value
    assert split("structured_data_types", "Product, Event") == ["Product", "Event"]  # made of known values: no whole
    assert split("structured_data_types", 'Offer | "Review ""Plus""" + vocab:Product') == ["Offer", 'Review "Plus"', "vocab:Product"]
    assert split("structured_data_types", 'Offer\n"Offer | Bundle"\thttps://t.example/v1/Event') == ["Offer", "Offer | Bundle", "https://t.example/v1/Event"]


def test_languages():
    assert split("hreflang", "en=https://a.test/p,1;fr-BE: https://a.test/p,2 | x-default|https://a.test/p/3,de https://a.test/4,") == ["en=https://a.test/p,1", "fr-BE: https://a.test/p,2", "x-default|https://a.test/p/3", "de https://a.test/4"]
    assert split("hreflang", "\"it https://a.test/1\" 'es https://a.test/2,3'") == ["it https://a.test/1", "es https://a.test/2,3"]


def test_odd_cells():
    assert split("meta_robots", ' ,;| "" ') == []
    assert split("meta_robots", '"index, follow') == ["index", "follow"]
    assert split("meta_robots", "index," * 5000) == ["index"] * 5000
    assert split("structured_data_types", "İ, Product") == ["İ", "Product"]


def test_frame(spark):
    rows = [(1, "index, follow", None, ""), (1, "index, follow", None, ""), (2, "index", "Product|Offer", "en=https://a.test/"), (None, "a;b", None, None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "ord bigint, meta_robots string, structured_data_types string, hreflang string, pos int")
    got = sorted((r.ord or 0, r.field_name, r.pos, r.item) for r in P.values(df, least=2).collect())
    pair = [(1, "meta_robots", 1, "index"), (1, "meta_robots", 2, "follow")]
    assert got == sorted([(0, "meta_robots", 1, "a"), (0, "meta_robots", 2, "b"), *pair, *pair, (2, "structured_data_types", 1, "Product"), (2, "structured_data_types", 2, "Offer")])
    assert P.values(df, least=1).count() == len(got) + 2
    assert P.values(df.limit(0), least=1).count() == 0


def test_dictionary_learns_whole_values(spark):
    df = spark.createDataFrame([(n, None, '"Store, Outdoor"' if n % 2 else "Product", None) for n in range(8)], "ord bigint, meta_robots string, structured_data_types string, hreflang string")
    assert sorted(P.dictionary(df)["structured_data_types"]) == ["Product", "Store, Outdoor"]


def test_case_of_letters_that_grow():
    assert P.fold("İx") == "İx" and P.fold("ΟΔΟΣ") == "οδοσ"
    assert split("structured_data_types", "Event; Local Business; Shoes; İlan") == ["Event", "Local Business; Shoes", "İlan"]


def _wide(spark):
    rows = [(n, "Index, follow" if n % 2 else "noindex", f'"Store {n % 70}, Outdoor" ; Offer+' if n % 3 else f"Type{n % 40}", "en=https://a.test/,1") for n in range(900)]
    rows += [(1000 + n, "max-snippet: 5 none", f"Store {n}, Outdoor | Type{n}/ x", None) for n in range(60)] + [(2000, None, '"Type1, Type2"', None)] * 4 + [(2001, None, "type1, TYPE2; İlan, store 3, outdoor", None)]
    return spark.createDataFrame(rows, "ord bigint, meta_robots string, structured_data_types string, hreflang string")


def test_dictionary_of_any_size(spark, monkeypatch):
    df = _wide(spark)
    want = sorted(map(tuple, P.values(df, least=2).collect()))
    assert (1007, "structured_data_types", 1, "Store 7, Outdoor") in want and (2001, "structured_data_types", 4, "store 3, outdoor") in want
    monkeypatch.setattr(P, "MOST_LOOKUP", 20)
    assert sorted(map(tuple, P.values(df, least=2).collect())) == want
    with __import__("pytest").raises(ValueError):
        P.dictionary(df)
