import pytest

from crawlquarry.config import CrawlSettings


def test_settings():
    s = CrawlSettings.of({"start_url": "https://a.test/", "max_urls": "100", "threads": "", "respect_robots": "false", "include": "a\nb\n"})
    assert (s.max_urls, s.threads, s.respect_robots, s.include, s.exclude) == (100, None, False, ["a", "b"], [])


@pytest.mark.parametrize("bad", [{"max_urls": 0}, {"max_urls": 5_000_001}, {"max_depth": 51}, {"threads": "x"}, {"urls_per_second": -1}, {"start_url": "ftp://x"}, {"colour": 1}])
def test_bounds(bad):
    with pytest.raises(ValueError):
        CrawlSettings.of({"start_url": "https://a.test/"} | bad)


def test_sitemaps_and_switches():
    s = CrawlSettings.of({"start_url": "https://a.test/", "sitemap_urls": "https://a.test/s.xml\n\n", "crawl_sitemap": "no", "crawl_subdomains": "on", "user_agent": "", "custom_config_path": "/x"})
    assert (s.sitemap_urls, s.crawl_sitemap, s.crawl_subdomains, s.user_agent, s.custom_config_path) == (["https://a.test/s.xml"], False, True, None, "/x")
