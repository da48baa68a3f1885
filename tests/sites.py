"""A small captured handbook, a page builder, and helpers that turn captured sites into tables."""

from datetime import datetime, timedelta
from html import escape
from string import Template

from pagetab.plans.crawl import crawl
from pagetab.sources import schemas

ORIGIN = "https://docs.example.com"
T0 = datetime(2024, 5, 1)

_LAYOUT = Template(
    '<html lang="en">\n<head>$head</head>\n<body>\n<header><nav><ul>$menu</ul></nav></header>\n'
    "<article>\n<section>$content</section>\n</article>\n<footer>printed on paper</footer>\n</body>\n</html>\n")

WEB, TXT = "application/xhtml+xml; charset=UTF-8", "text/plain; charset=us-ascii"


def page(to=(), says="An entry of the handbook.", named="Entry"):
    """A captured page: a menu that leads ``to`` other places, then its content; no title if ``named`` is None."""
    menu = "\n".join('<li><a href="%s">go</a></li>' % escape(place) for place in to)
    head = "<title>%s</title>" % escape(named) if named is not None else '<meta name="x" content="y">'
    return 200, {"type": WEB}, _LAYOUT.substitute(head=head, menu=menu, content=escape(says))


# what each page of the handbook is and where it leads
_MENUS = {
    "/": ["/install", "faq?print=1", "/drafts/plan", "/faq", "/old", "/install/", "/install#linux"],
    "/install": ["/api/v1", "api/v2", "/"],
    "/faq": ["/install"],
    "/api/v1": [],
    "/api/v2": ["/install", "/gone"],
    "/drafts/plan": ["/drafts/more"],
}
HANDBOOK = {
    path: page(menu, "About " + path, None if path == "/api/v1" else "@" + path) for path, menu in _MENUS.items()
} | {
    "/robots.txt": (200, {"type": TXT}, "User-agent: *\nDisallow: /drafts\n"),
    "/old": (307, {"location": "faq"}, ""),
    "/gone": (410, {"type": TXT}, "removed"),
    "/install/": (200, {"type": "application/zip"}, b"PK"),
}


def tables(spark, sites):
    """sites: crawl_id -> (routes, policy overrides); unlisted paths stay uncaptured."""
    policies, robots, responses = [], [], []
    limits = ("max_pages", "max_requests", "max_candidates", "max_body_bytes", "max_text_chars", "delay", "timeout", "allow_loopback")
    for crawl_id, (routes, policy) in sites.items():
        policies.append((crawl_id, policy.get("start_url", ORIGIN + "/"), policy.get("allowed_origin", ORIGIN), *map(policy.get, limits)))
        answers = {"/robots.txt": (404, {"type": TXT}, "none"), **routes}
        for n, (path, (status, about, body)) in enumerate(answers.items()):
            raw = body.encode() if isinstance(body, str) else body
            if path == "/robots.txt":
                robots.append((crawl_id, status, about.get("type"), about.get("encoding"), raw.decode(), None))
            else:
                responses.append((
                    crawl_id, about.get("id", n), ORIGIN + path, status, about.get("type"), about.get("encoding"), about.get("location"),
                    raw, T0 + timedelta(minutes=n), about.get("error")))
    return (
        spark.createDataFrame(policies, schemas.POLICIES), spark.createDataFrame(robots, schemas.ROBOTS),
        spark.createDataFrame(responses, schemas.RESPONSES))


def run(spark, sites, **options):
    return crawl(*tables(spark, sites), **options)
