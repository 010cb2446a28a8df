"""Literal rows for operators whose inputs no table has."""

from __future__ import annotations


class Rows:
    """Rows as a SELECT over VALUES for Spark (``select``) and as a subquery for DuckDB (``sql``)."""

    def __init__(self, columns: str, rows: list[tuple]):
        self.columns, self.rows = columns, rows

    @staticmethod
    def _spark(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).lower()
        return str(value) if isinstance(value, (int, float)) else "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    @staticmethod
    def _duck(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).lower()
        return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    def select(self) -> str:
        values = ", ".join("(" + ", ".join(map(self._spark, r)) + ")" for r in self.rows)
        return f"SELECT * FROM VALUES {values} AS t({self.columns})"

    def sql(self) -> str:
        values = ", ".join("(" + ", ".join(map(self._duck, r)) + ")" for r in self.rows)
        return f"(SELECT * FROM (VALUES {values}) t({self.columns}))"


URLS = Rows("id, url", [(k, u) for k, u in enumerate([
    "http://www.Site.test/Path/", "https://site.test", "https://site.test/a?utm_source=x&b=2&a=1", "https://site.test/a#part", "ftp://site.test/a", "", None,
    "https://site.test//", "https://site.test/a/b;v=1?q=%7Ex", "http://localhost:8080/x/", "https://user:pw@site.test:99/p", "  https://site.test/s p ",
    "https://site.test/?fbclid=1", "https://site.test/a?b=&c", "https://site.test/a?B=2&a=1&A=0", "https://[bad/x", "HTTPS://SITE.TEST/UP", "https://site.test/a?x=a+b&y=%20", "//site.test/a", "/a/b", "mailto:a@site.test",
])])
CLEAN_URLS = Rows("id, url", [(k, u) for k, u in enumerate([
    "https://s.test/", "https://s.test/blog", "https://s.test/blog/first", "https://s.test/news-detail/x", "https://s.test/jobs/dev", "https://s.test/vacancy", "https://s.test/careers",
    "https://s.test/products/a-b", "https://s.test/case-studies/x", "https://s.test/success-story/x", "https://s.test/about/team/jo", "https://s.test/webinars/1", "https://s.test/knowledge-base/1",
    "https://s.test/about-us", "https://s.test/contact", "https://s.test/terms", "https://s.test/other", "https://s.test/other/more", "https://s.test/de/blog/eins", "https://s.test/BLOG/X",
    "https://s.test/file.pdf", "https://s.test/static/x", "https://s.test/wp-admin", "https://s.test/send-mail.php", "https://s.test/page.php", "https://s.test/blog-details", "https://s.test/x-detail",
    "https://s.test/a?id=1", "https://s.test/a?id=1&p=2", "https://s.test/a?tag=1", "https://s.test/a?other=1", "https://s.test/a?S=1", "https://s.test/events", "https://s.test/faq", "https://s.test/faq/1",
])])
HREFS = Rows("id, raw", [(k, u) for k, u in enumerate(["#", "#!", "", None, "javascript:void(0)", "JavaScript:void(0);", " /a ", "/", "/x{y}", "mailto:a@b", "TEL:1", "data:x", "whatsapp:1", "page.html", "https://a.test"])])
PREFIXES = Rows("prefix", [("/blog",), ("/services/s",), ("/careers/digital",)])
ROBOTS = Rows("host, body", [
    ("a.test", "User-agent: *\nDisallow: /private/\nDisallow: /\nDisallow:\nUser-agent: other\nDisallow: /no\nuser-agent: bot\ndisallow: /Tmp"),
    ("b.test", "Disallow: /early\nUser-agent: Googlebot\nAllow: /x\nDisallow: /x/y/"), ("c.test", "User-agent: googlebot\nDisallow: /z"), ("d.test", ""),
])
SITEMAPS = Rows("url, body", [
    ("https://site.test/sitemap.xml", "<urlset><url><loc> https://site.test/a </loc></url><LOC>https://www.site.test/c/</LOC><loc>https://site.test/pages.xml</loc><loc>https://else.test/x</loc></urlset>"),
    ("https://site.test/pages.xml", "<loc>https://site.test/b?utm_source=s</loc><loc>http://site.test/a#x</loc><loc>https://site.test/sitemap.xml</loc><loc></loc>"),
    ("https://site.test/unseen.xml", "<loc>https://site.test/never</loc>"),
])
REQUESTS = Rows("id, url, resource", [(1, "https://s.test/a.png", "image"), (2, "https://www.Google-Analytics.com/c", "script"), (3, "https://s.test/app.js", "script"), (4, "https://facebook.com/tr?id=1", "xhr"), (5, "https://facebook.com/page", "document"), (6, "https://s.test/f", "font")])
CANONICALS = Rows("id, url, canonical", [(1, "https://s.test/blog/a", "https://s.test/blog/"), (2, "https://s.test/blog/a", "https://s.test/blog/a/"), (3, "https://s.test/vacancy/a", "https://s.test/vacancy"), (4, "https://s.test/jobs/a", "https://s.test/Jobs"), (5, "https://s.test/x/a", "https://s.test/x"), (6, "https://s.test/jobs/a", "https://s.test/blog"), (7, "https://s.test/", "https://s.test")])
HTML = Rows("id, url, html", [
    (1, "https://s.test/a/b", "<html><head><title> One page </title><link rel=\"canonical\" href=\"/a/one\"></head><body><nav><ul><li><a href=\"/home\">Home</a></li></ul></nav><main><h1>One <b>heading</b></h1><p>First text with enough words.<p>Second <a href=\"two.html\" title=\"t\">link</a></main><footer>end of the page</footer></body></html>"),
    (2, "https://s.test/a/c", "<title>Two</title><nav><ul><li><a href=\"/home\">Home</a></li></ul></nav><div class=\"post-content\"><h2 class=\"page_title\">Second title</h2><a href=\"#\">x</a><a href='javascript:void(0)'>y</a><img src=\"/i.png\" alt=\"pic\"></div><footer>end of the page</footer>"),
    (3, "https://s.test/d", "<meta http-equiv=\"refresh\" content=\"0; url='/next'\"><script type=\"application/ld+json\">{\"@id\": \"https://s.test/id\", \"mainEntityOfPage\": {\"url\": \"https://s.test/main\"}}</script><script id=\"__NEXT_DATA__\">{\"a\": {\"path\": \"/deep/page\"}}</script><div data-href=\"/data\">d</div><div onclick=\"window.open(\"/popup\")\">p</div>"),
    (4, "https://s.test/e", ""),
    (5, "https://s.test/f", "<body><h3 class=\"post_title\">Third</h3><table><tr><th>a<th>b<tr><td>1<td>2</table><ul><li>x<li>y</ul><a href=\"mailto:a@b\">m</a><a href=\"/{tpl}\">t</a><pre>code  here</pre></body>"),
])
ONCLICK = Rows("id, onclick", [(1, "submitForm(event, 'dev-1', 'Dev', 'career-details')"), (2, "navigateTo('item-2', '/section')"), (3, "go(event, '/a/b'); x('/a/b.js')"), (4, "short('/a/b')"), (5, None), (6, "openDetail(this) || load('/x/y/z')")])
JOINS = Rows("id, base, link", [(k, "https://s.test/a/b?x=1", link) for k, link in enumerate(["/c", "c", "./c", "../c", "//t.test/c", "https://t.test/", "?y=2", "#f", ""])])
MARKDOWN = Rows("id, md", [(1, "# A\ntext\n# A\nmore\n## a\n# B\n# A"), (2, "no heading"), (3, "# *A*\n#A\n# A"), (4, "")])
GATE = Rows("seq, url, canonical", [
    (1, "https://s.test/a", None), (2, "https://s.test/b", "https://s.test/c"), (3, "https://s.test/d", "https://s.test/c"), (4, "https://s.test/e", None),
    (5, "https://s.test/f", "https://s.test/a"), (6, "https://s.test/x", "https://s.test/f"), (7, "https://s.test/g", None), (8, "https://s.test/h", "https://s.test/g"), (9, "https://s.test/i", "https://s.test/h"),
])
ETAS = Rows("id, queue, crawled, max_pages, recent, span, elapsed", [(1, 10, 5, 100, 4, 8, 20), (2, 0, 100, 100, 9, 30, 90), (3, 50, 2, 100, 1, 0, 5), (4, 5, 60, 100, 30, 60, 200), (5, 40, 60, 100, 0, 0, 9000), (6, 0, 0, 10, 0, 0, 0)])

_BODY = "<main><h1>%s</h1><p>" + " ".join(f"word{k} and" for k in range(60)) + "</p></main>"
CRAWLED = Rows("job_id, seq, url, html, http_status, revealed_text", [
    ("j", 1, "https://s.test/blog/one", _BODY % "One", None, None), ("j", 2, "https://s.test/blog/two", _BODY % "One", None, None),
    ("j", 3, "https://s.test/blog/three", '<link rel="canonical" href="/blog/one">' + _BODY % "Three", None, None), ("j", 4, "https://s.test/gone", "<h1>Gone</h1>", 404, None),
    ("j", 5, "https://s.test/short", "<p>few words</p>", None, None), ("j", 6, "https://s.test/denied", "<title>Access denied</title>" + "<p>text</p>" * 90, None, None),
    ("j", 7, "http://www.s.test/blog/one/#again", _BODY % "Other", None, None), ("j", 8, "https://s.test/tail", "<h1>Tail</h1><p>start</p>", None, "more revealed words in a row " * 8),
])
REQUEST_BODIES = Rows("id, body", [
    (1, '{"url": "https://s.test", "tenant_id": "t", "agent_id": "a", "unknown": 1}'), (2, '{"url": "https://s.test", "tenant_id": "t", "agent_id": "a", "max_pages": 5, "max_depth": 21}'),
    (3, '{"url": "ftp://s.test", "tenant_id": "t"}'), (4, None), (5, '{"url": "https://s.test", "agent_id": "a", "max_pages": 0}'),
])
REJECTS = Rows("id, url, root, rules", [(k, u, "s.test", "/private /privateer") for k, u in enumerate([
    "", None, "ftp://s.test/", "https://[x/", "https://t.test/", "https://blog.s.test/", "https://s.test/a.pdf", "https://s.test/static/a", "https://s.test/wp-admin/x", "https://s.test/send.php", "https://s.test/a?tag=x",
    "https://s.test/a?id=1&p=2", "https://s.test/" + "a/" * 13, "https://s.test/blog-details", "https://s.test/privateer", "https://s.test/PRIVATE/x/", "https://s.test/ok?id=1", "https://www.s.test/ok", "https://s.test/static/a.pdf?tag=1", "http://s.test/private.png",
])])
STATES = Rows("id, state", [(1, '{"x": ["/a", {"y": "/b/c"}, "no"], "z": "/"}'), (2, "no json"), (3, None), (4, '["../up", "/one/../two", 5, null, true]')])
CONTROLS = Rows("page, row, text, aria_label, visible, in_nav", [
    ("p", 1, "Show more", None, True, False), ("p", 2, "SHOW MORE ", "", True, False), ("p", 3, "Accept all", None, True, False), ("p", 4, "Menu", None, True, True), ("p", 5, "Tab", "second", False, False),
    ("p", 6, None, "Open panel", True, False), ("p", 7, "Details", "Subscribe here", True, False), ("p", 8, "Beyond", None, True, False), ("q", 1, "Details", "of the plan", True, False),
])
LOADS = Rows("page_id, attempt, problem, http_status, error", [(1, 1, None, 200, None), (2, 1, "error", None, "reset"), (2, 2, None, 404, None), (3, 1, "error", None, "refused"), (3, 2, "error", None, "e" * 300), (4, 1, "timeout", None, "slow"), (5, 1, "error", None, "a"), (5, 2, "error", None, "b"), (5, 3, None, 200, None)])
