"""Settings of a crawl, checked when they are made. Not a query: what lands in the export folder was crawled by them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

#: Bounds of the numbers (least, most); None is open.
BOUNDS: dict[str, tuple[float | None, float | None]] = {"max_urls": (1, 5_000_000), "max_depth": (0, 50), "threads": (1, 50), "urls_per_second": (0, None)}


@dataclass(frozen=True)
class CrawlSettings:
    start_url: str
    max_urls: int | None = None
    max_depth: int | None = None
    threads: int | None = None
    urls_per_second: float | None = None
    respect_robots: bool = True
    crawl_subdomains: bool = False
    render_scripts: bool = False
    crawl_sitemap: bool = True
    user_agent: str | None = None
    custom_config_path: str | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    sitemap_urls: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.start_url.lower().startswith(("http://", "https://")):
            raise ValueError("start_url must be an http or https address")
        for name, (low, high) in BOUNDS.items():
            v = getattr(self, name)
            if v is not None and (low is not None and v < low or high is not None and v > high):
                raise ValueError(f"{name} must be between {low} and {high}")

    @classmethod
    def of(cls, raw: dict[str, object]) -> CrawlSettings:
        """From a form: texts become numbers and booleans, blanks are left out, unknown names are refused."""
        kinds = {f.name: f.type for f in fields(cls)}
        if unknown := set(raw) - set(kinds):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        out: dict[str, object] = {}
        for name, v in raw.items():
            if v is None or v == "":
                continue
            kind = kinds[name]
            if "int" in kind:
                v = int(str(v))
            elif "float" in kind:
                v = float(str(v))
            elif kind == "bool":
                v = str(v).lower() in ("true", "1", "yes", "on")
            elif kind.startswith("list"):
                v = list(v) if isinstance(v, (list, tuple)) else [x for x in str(v).splitlines() if x.strip()]
            out[name] = v
        return cls(**out)
