"""Small literal tables for branches that crawled pages may not show, used by queries and by their SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

URLS = (
    "https://www.acme.io/", "http://WWW.Acme.io:8080/About-Us/?q=1#f", " acme.io/Contact ", "https://acme.io/our-services/consulting;v=1",
    "https://acme.io/services", "https://acme.io/blog/post-1", "https://acme.io/team/jane-doe", "https://acme.io/index.html",
    "https://acme.io/p?b=2&UTM_Source=x&a=1&b=3#f", "https://acme.io?ref=x", "https://acme.io/p?q=a%20b&e=&t=1+1", "https://acme.io/a//b/",
    "https://acme.io/pricing/plans/rates", "https://mybookshop.com/x", "https://company.com/x", "https://web.com/faq", "https://acme.io/privacy-policy",
    "https://acme.io/people-and-staff/leadership", "https://acme.io/en/98", "https://shop.acme.co.uk/locations/offices",
)
HOSTS = (
    "https://localhost/x", "https://127.0.0.1", "https://10.0.0.8:80/a", "https://acme.io", "https://acme", "https://shop.acme.co.uk/a",
    "https://co.uk", "https://a..io", "https://acme.invalidname", "https://user@acme.com:8443/x",
)
PATHS = ("/contact", "/about-us", "/services", "/our-team", "/pricing", "/locations", "/faq", "/booking", "/blog/post", "/en/98", "/treatments/laser", "/")
EMAILS = (
    "support@acme.io", "info@acme.io", "sales@acme.io", "jo@gmail.com", "jo@acme.io", "info@example.com", "sysadmin@acme.io", "a@latest.com",
    "newsletter@acme.io", "jane.contact@acme.io", "Help@Acme.io", "bounce+1@acme.io", "0123456789abcdef0123456789abcdef@acme.io", "hello@acme.io",
    "quote@acme.io", "no-at-sign", "", "x@y", ".a@acme.io", "a..b@acme.io",
)
TEXTS = (
    "Visit us: 123 Main St, Springfield, IL 62701 or call.", "500 Oak Avenue, Portland, OR 97201 and 7 Elm Rd, Salem, OR 97301", "10 Low Lane, Nowhere, ZZ 12345",
    "no address here", "",
)
MARKUP = (
    "<html><body><form class='contact-form'><input name='a'></form><script src='https://www.google-analytics.com/ga.js'></script></body></html>",
    '<div class="pricing"><p>From $20 a month</p></div><link href="/wp-content/x.css"><script>Intercom("boot")</script>',
    '<a href="https://wa.me/15551234567">WhatsApp</a><a href="https://calendly.com/acme">Book an appointment</a><a href="/careers/jobs">We are hiring</a>',
    "<section id='faq'>Frequently  asked questions</section><img src='https://www.facebook.com/tr?id=1'><script src='//js.hubspot.com/x.js'></script>",
    "<p>Meet the team. Global presence in 3 countries.</p><script src='https://cdn.shopify.com/s.js'></script><script src='https://js.stripe.com/v3'></script>",
    "<p>nothing</p>", "",
)
LINKS = (
    "https://www.linkedin.com/company/acme", "https://facebook.com/acme", "http://m.facebook.com/acme", "https://x.com/acme", "https://twitter.com/acme",
    "https://youtu.be/abc", "https://www.tiktok.com/@acme", "https://github.com/acme", "/relative", "https://wix.com/acme", "//instagram.com/acme",
    "https://wa.me/15551234567", "https://notfacebook.com/x", "mailto:a@acme.io",
)
JSONLD = (
    '{"@type": "Organization", "name": "Acme", "telephone": "+15551234567", "email": "hi@acme.io", "logo": {"url": "https://acme.io/l.png"}, "address": {"streetAddress": "1 Main St", "addressLocality": "Salem", "addressRegion": "OR", "postalCode": "97301"}}',
    '[{"@type": "Person", "name": "Jane"}, {"@type": "WebPage", "name": "x"}, 3]',
    '{"@type": "Store", "name": "Shop", "logo": "https://acme.io/s.png", "openingHoursSpecification": {"dayOfWeek": "Monday", "opens": "09:00", "closes": "17:00"}}',
    '{"@type": ["Organization"], "name": "listed"}', "{broken", "",
)
#: url, title, h1, meta description, body
SIGNALS = (
    ("https://acme.io/", "Acme", "Welcome", "", "our team of people"), ("https://acme.io/contact", "Contact us", "Get in touch", "reach out", "send message"),
    ("https://acme.io/x1", "Our pricing plans", "Pricing", "", ""), ("https://acme.io/x2", "", "", "", ""), ("https://acme.io/careers", "Jobs", "Join us", "hiring now", "open positions"),
    ("https://acme.io/services", "About us", "Who we are", "our mission", "founded 1990"), ("https://acme.io/blog/post", "FAQ", "Questions", "help", "support"),
)
#: group, pos, confidence, source
SCORES = (("a", 0, 0.99, "schema"), ("a", 1, 0.80, "visible"), ("b", 0, 0.55, "regex"), ("b", 1, 0.80, "visible"), ("b", 2, 0.80, "form"), ("c", 0, 0.50, "regex"), ("d", 0, 0.99, "schema"), ("d", 1, 0.99, "mailto"))
_NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
SITEMAPS = (
    ("https://acme.io/sitemap.xml", f"<sitemapindex {_NS}><sitemap><loc>https://acme.io/a.xml</loc></sitemap><sitemap><loc> https://acme.io/b.xml </loc></sitemap></sitemapindex>"),
    ("https://acme.io/a.xml", f"<urlset {_NS}><url><loc>https://acme.io/1</loc></url><url><loc>https://acme.io/2</loc></url></urlset>"),
    ("https://acme.io/b.xml", f"<sitemapindex {_NS}><sitemap><loc>https://acme.io/a.xml</loc></sitemap><sitemap><loc>https://acme.io/sitemap.xml</loc></sitemap><sitemap><loc>https://acme.io/c.xml</loc></sitemap></sitemapindex>"),
    ("https://acme.io/c.xml", "<urlset><url><loc>https://acme.io/3</loc></url></urlset>"),
    ("https://other.io/sitemap_index.xml", f"<urlset {_NS}><url><loc>https://other.io/x</loc></url></urlset>"),
    ("https://orphan.io/z.xml", f"<urlset {_NS}><url><loc>https://orphan.io/x</loc></url></urlset>"),
)
SITES = (("acme.io", "https://acme.io"), ("other.io", "https://other.io/"), ("none.io", "https://none.io"))

#: Pages of two small sites, with what crawled pages seldom have.
PAGES = (
    (-1, "https://www.acme.io/", """<html lang="en"><head><title>Acme | Tools</title><meta name="description" content="We make tools."><meta property="og:site_name" content="Acme Inc"><link rel="canonical" href="https://acme.io/">
<script type="application/ld+json">{"@type": "Organization", "name": "Acme Corporation", "email": "info@acme.io", "telephone": "+15552345678"}</script></head>
<body><header><img src="/logo.png"></header><nav><a href="/about">About</a><a href="/contact">Contact</a><a href="#top">Top</a></nav><h1>Welcome to Acme</h1>
<p>Acme has made tools for people who build things since nineteen ninety, in a small town by the sea.</p><div class="card"><h3>Hammers</h3><p>All kinds of hammers.</p><a href="/hammers">More</a></div>
<a href="mailto:info@acme.io?subject=hi">Mail</a><a href="tel:+1 555 234 5678">Call</a><a href="https://facebook.com/acme">fb</a><footer>&copy; Acme 2024 <a href="mailto:office@acme.io">Office</a></footer></body></html>"""),
    (-2, "https://www.acme.io/contact", """<html><head><title>Contact</title></head><body><h1>Contact Acme</h1><form action="/send" id="contact"><input name="email"><input type="hidden" name="csrf"><textarea name="message"></textarea><button>Send</button></form>
<address>1 Main St, Salem, OR 97301</address><p>Acme has made tools for people who build things since nineteen ninety, in a small town by the sea.</p><a href="https://maps.google.com/?q=acme">Map</a>
<p>Monday 09:00 to 17:00</p><a href="mailto:support@acme.io">Support</a><a href="tel:5552345678">Call</a></body></html>"""),
    (-3, "https://www.acme.io/team/jane-doe", """<html><body><h1>Jane Doe</h1><section class="team"><div class="member"><h3 class="name">Jane Doe</h3><span class="role">Founder</span></div></section><h2>About Jane</h2></body></html>"""),
    (-4, "https://beta.io/services", """<html><head><title>Beta - Services</title></head><body><div id="services"><h2>Roof repair</h2><ul><li>Tiles</li><li>Gutters and drains</li></ul></div><table><tr><th>Job</th><th>Price</th></tr><tr><td>Roof</td><td>$90</td></tr></table>
<ol><li>Call</li><li>Pay</li></ol><script src="https://cdn.shopify.com/x.js"></script></body></html>"""),
    (-5, "https://www.acme.io/about", """<html><head><title>About</title></head><body><h1>About Acme</h1><h2>Welcome to Acme</h2><h2>Our story</h2>
<p>Acme has made tools for people who build things since nineteen ninety, in a small town by the sea.</p><p>In two thousand and four we moved into the old harbour hall, where all our tools are made to this day.</p>
<div class="feature"><h3>Hammers</h3><p>All kinds of hammers.</p><a href="/hammers">More</a></div><div class="feature"><h3>Saws</h3><p>Sharp ones.</p></div>
<a href="mailto:info@acme.io">Mail</a><a href="mailto:jobs@acme.io">Jobs</a></body></html>"""),
)


def table(spark: SparkSession, rows, columns: str) -> DataFrame:
    """Rows of plain values as a table, with their position as ``pos``."""
    names = [c.split()[0] for c in columns.split(", ")]
    data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"pos long, {columns}").select("pos", *names)


def values(rows, columns: str) -> str:
    """The same table as SQL."""
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    names = [c.split()[0] for c in columns.split(", ")]
    body = ", ".join("(" + ", ".join([str(i), *map(quote, r if isinstance(r, tuple) else (r,))]) + ")" for i, r in enumerate(rows))
    return f"(VALUES {body}) AS t(pos, {', '.join(names)})"


def literals(rows) -> str:
    """Rows of plain values as SQL, with the types that Spark gives them."""
    def one(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"{v!r}::{'DOUBLE' if isinstance(v, float) else 'BIGINT'}"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"
