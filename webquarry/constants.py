"""Word lists, scores, patterns and formats that results depend on. Order matters where it breaks ties."""

from __future__ import annotations

# --- URLs -----------------------------------------------------------------
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "gclsrc",
    "ref", "source", "campaign", "medium", "content",
)
SLUG_IGNORE = ("the", "a", "an", "and", "or", "is", "are", "was", "were", "www", "index", "default", "home", "main")
#: Subset of the public suffixes: these, these below a country, and any two-letter country code.
GENERIC_SUFFIXES = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "io", "app", "dev", "ai", "shop", "online", "site", "store", "tech", "xyz", "agency", "clinic", "dental")
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov", "edu")

# --- page ranking by URL ----------------------------------------------------
PAGE_TYPE_SCORES = {
    "contact": 100, "about": 95, "services": 90, "team": 85, "pricing": 80, "treatments": 80, "locations": 75, "faq": 70, "booking": 65,
    "blog": -500, "news": -500, "posts": -500, "author": -500, "category": -500, "archives": -500, "tag": -500, "search": -500,
    "feed": -500, "rss": -500, "privacy": -500, "terms": -500, "legal": -500, "cookie": -500, "sitemap": -500, "robots": -500,
}
PAGE_TYPE_KEYWORDS = {
    "contact": ("contact", "contact-us", "get-in-touch", "reach-out", "support"),
    "about": ("about", "about-us", "who-we-are", "our-story", "company"),
    "services": ("services", "solutions", "offerings", "what-we-do"),
    "team": ("team", "our-team", "people", "staff", "leadership"),
    "pricing": ("pricing", "plans", "costs", "rates", "packages"),
    "treatments": ("treatments", "procedures", "services"),
    "locations": ("locations", "offices", "branches", "our-locations"),
    "faq": ("faq", "frequently-asked", "q&a"),
    "booking": ("book", "appointment", "schedule", "booking"),
    "blog": ("blog", "news", "article", "post", "posts", "insight"),
    "author": ("author", "author-page"),
    "category": ("category", "categories"),
    "archives": ("archive", "archives"),
    "tag": ("tag", "tags"),
    "search": ("search", "results"),
    "feed": ("feed", "rss"),
    "privacy": ("privacy", "privacy-policy"),
    "terms": ("terms", "terms-of-service", "legal"),
    "cookie": ("cookie", "cookies"),
    "sitemap": ("sitemap",),
    "robots": ("robots.txt",),
}
# --- page classification by content -----------------------------------------
CONTENT_KEYWORDS = {
    "contact": ("contact us", "get in touch", "reach out", "email us", "call us", "contact form", "send message", "inquiry", "support"),
    "about": ("about us", "who we are", "our story", "company history", "our mission", "about company", "team history", "founded", "established"),
    "services": ("services", "what we offer", "our services", "solutions", "offerings", "service offerings", "capabilities", "expertise"),
    "team": ("team", "our team", "staff", "leadership", "management", "people", "meet our team", "team members", "employees"),
    "pricing": ("pricing", "plans", "packages", "rates", "costs", "pricing plans", "our pricing", "price list", "subscription"),
    "treatments": ("treatments", "procedures", "services offered", "medical procedures", "dental treatments", "therapy"),
    "locations": ("locations", "offices", "branches", "our locations", "find us", "office locations", "store locations"),
    "careers": ("careers", "jobs", "employment", "join us", "work with us", "job opportunities", "hiring", "positions"),
    "faq": ("faq", "frequently asked questions", "q&a", "questions", "help", "support", "common questions"),
}
SIGNAL_WEIGHTS = {"title": 1.5, "h1": 1.3, "meta_description": 1.0, "body_text": 0.8}
# --- evidence page types (substrings of the whole URL) ----------------------
PROFILE_MARKS = ("/team/", "/about/team/", "/meet-the-team/", "/our-team/", "/staff/")
EVIDENCE_TYPE_KEYWORDS = {
    "about": ("about", "who-we-are", "our-story", "company"),
    "contact": ("contact", "contact-us", "get-in-touch"),
    "services": ("services", "solutions", "offerings"),
    "team": ("team", "our-team", "people", "staff"),
    "pricing": ("pricing", "plans", "rates"),
    "locations": ("locations", "offices", "branches"),
    "faq": ("faq", "frequently-asked"),
    "booking": ("book", "appointment", "schedule"),
}
#: The order in which a site's pages are cleaned; the first nine but profiles are slots of one page.
CLEANING_ORDER = ("homepage", "about", "contact", "services", "team", "team_profile", "pricing", "locations", "faq", "booking")
SLOTS = ("homepage", "about", "contact", "services", "team", "pricing", "locations", "faq", "booking")
TECHNOLOGY_PAGES = ("homepage", "about", "contact", "services", "team", "team_profile")

# --- extraction ---------------------------------------------------------------
HEADING_BOILERPLATE = ("menu", "cookie", "subscribe")
PARAGRAPH_BOILERPLATE = ("cookie", "privacy policy", "terms of service", "newsletter", "subscribe")
CARD_CLASSES = ("card", "feature", "service", "team", "box")
HOURS_WORDS = ("hours", "open", "close", "monday", "am", "pm")
MAPS_MARKS = ("maps.google.com", "google.com/maps")
WHATSAPP_MARKS = ("whatsapp.com", "wa.me")
CALENDAR_MARKS = ("calendly.com", "acuityscheduling.com", "setmore.com")
FOOTER_SOCIAL_MARKS = ("facebook", "twitter", "instagram", "linkedin", "youtube")
FORM_MARKS = {
    "contact": ("contact", "message", "inquiry"),
    "booking": ("book", "appointment", "schedule", "reservation"),
    "newsletter": ("subscribe", "newsletter", "email"),
}
HIDDEN_FIELD_MARKS = (
    "__", "csrf", "nonce", "token", "signature", "hmac", "_wpnonce", "recaptcha", "g-recaptcha", "captcha", "honeypot", "tracking",
    "_hidden", "_token", "_id", "_key", "hash", "time", "action",
)
IMPORTANCE = {"email": 10, "phone": 10, "script": 7, "other": 5}
# --- contacts -----------------------------------------------------------------
EMAIL_PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
US_STATES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD",
    "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC",
    "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC", "PR", "VI", "GU", "AS", "MP",
)
ADDRESS_PATTERN = (
    r"(\d+\s+[\w\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Circle|Cir|Way|Place|Pl)?)"
    r"\s*,?\s*([\w\s]+),?\s*([A-Z]{2})\s+(\d{5})"
)
PHONE_PATTERNS = (
    r"\+?1?\s*\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
    r"\+[1-9]\d{1,14}",
    r"(?:phone|tel|contact):\s*([+\d\s\-()]+)",
)
SOCIAL_DOMAINS = {
    "linkedin.com": "linkedin", "facebook.com": "facebook", "fb.com": "facebook", "instagram.com": "instagram", "twitter.com": "twitter",
    "x.com": "twitter", "youtube.com": "youtube", "youtu.be": "youtube", "tiktok.com": "tiktok", "github.com": "github",
}
SOCIAL_PATTERNS = {
    "linkedin": (r"linkedin\.com/(?:company|in)/[\w-]+", r"linkedin\.com/.*"),
    "facebook": (r"facebook\.com/[\w./-]+", r"fb\.(?:me|com)/[\w-]+"),
    "twitter": (r"(?:twitter|x)\.com/[\w]+", r"x\.com/[\w]+"),
    "instagram": (r"instagram\.com/[\w.]+",),
    "youtube": (r"youtube\.com/(?:user|channel|c)/[\w-]+", r"youtube\.com/@[\w-]+", r"youtu\.be/[\w-]+"),
    "tiktok": (r"tiktok\.com/@[\w.-]+",),
    "github": (r"github\.com/[\w-]+",),
    "whatsapp": (r"wa\.me/[\d]+", r"whatsapp\.com/.*"),
    "telegram": (r"t\.me/[\w]+", r"telegram\.me/[\w]+"),
    "discord": (r"discord\.(?:gg|com)/[\w-]+",),
    "reddit": (r"reddit\.com/r/[\w-]+", r"reddit\.com/u/[\w-]+"),
}
# --- e-mail quality -----------------------------------------------------------
SYSTEM_MARKS = (
    "sentry.wixpress.com", "sentry-next.wixpress.com", "mail.wixpress.com", "cloudflare.com", "fastmail.com", "googleusercontent.com",
    "noreply@google.com", "noreply", "donotreply", "no-reply", "notification", "system", "admin", "webmaster", "localhost",
    "example.com", "test.com", "bounce", "mailer-daemon", "postmaster",
)
EMAIL_CATEGORIES = (
    ("support", r"^(support|help|assistance|service)@"),
    ("sales", r"^(sales|quote|pricing|business)@"),
    ("marketing", r"^(marketing|newsletter|promo|campaign)@"),
    ("business", r"^[a-z.]*(info|contact|hello|support|sales)@"),
    ("personal", r"@(gmail|yahoo|hotmail|outlook|aol|protonmail)\.com$"),
)
EMAIL_CONFIDENCE = {"business": 0.95, "support": 0.90, "sales": 0.90, "marketing": 0.85, "personal": 0.70, "system": 0.0, "unknown": 0.50}
VERIFIED_ORDER = ("business", "support", "sales", "marketing")
FAKE_EMAIL_MARKS = (
    "sentry.wixpress.com", "sentry-next.wixpress.com", "cloudflare.com", "googleusercontent.com", "localhost", "example.com", "test.com",
    "noreply", "no-reply", "donotreply", "bounce", "mailer-daemon", "postmaster", "tracking",
)
# --- technology and features --------------------------------------------------
TECHNOLOGIES = (
    ("WordPress", "cms", ("/wp-content/", "/wp-includes/", "wp-json")),
    ("Shopify", "cms", ("cdn.shopify.com", "shopify.com/s/", "Shopify.theme")),
    ("Webflow", "cms", ("webflow.com", "data-wf-page", "data-wf-site")),
    ("Squarespace", "cms", ("squarespace.com", "static1.squarespace.com")),
    ("Wix", "cms", ("wix.com", "wixstatic.com", "X-Wix-")),
    ("Ghost", "cms", ("ghost.io", "content.ghost.io")),
    ("Google Analytics", "analytics", ("google-analytics.com", "gtag('config", "ga('create")),
    ("Google Tag Manager", "analytics", ("googletagmanager.com", "GTM-")),
    ("Meta Pixel", "analytics", ("connect.facebook.net", "fbq('init", "facebook-jssdk")),
    ("Hotjar", "analytics", ("hotjar.com", "hj('create")),
    ("Mixpanel", "analytics", ("mixpanel.com", "mixpanel.init")),
    ("Segment", "analytics", ("cdn.segment.com", "analytics.load")),
    ("Intercom", "widgets", ("intercomcdn.com", "intercom.io", "Intercom(")),
    ("Zendesk", "widgets", ("zendesk.com", "zdassets.com", "zE(")),
    ("Drift", "widgets", ("js.driftt.com", "drift.com")),
    ("Crisp", "widgets", ("client.crisp.chat", "CRISP_WEBSITE_ID")),
    ("Tawk.to", "widgets", ("tawk.to", "embed.tawk.to")),
    ("Calendly", "booking", ("calendly.com", "assets.calendly.com")),
    ("Acuity Scheduling", "booking", ("acuityscheduling.com",)),
    ("SimplyBook", "booking", ("simplybook.me",)),
    ("HubSpot", "booking", ("js.hubspot.com", "hubspot.com", "hs-scripts.com")),
    ("Cloudflare", "widgets", ("cloudflare.com", "__cf_bm", "cf-ray")),
    ("Stripe", "widgets", ("js.stripe.com", "stripe.com/v3")),
)
FEATURE_PATTERNS = {
    "has_contact_form": (r"""<form[^>]*class=["'].*contact""", r"""<form[^>]*id=["'].*contact""", r"contact-form", r"enquiry-form", r"inquiry-form", r"message-form"),
    "has_booking": (r"book\s+(an?\s+)?appointment", r"schedule\s+appointment", r"reserve\s+(a\s+)?slot", r"booking\.com", r"calendly", r"acuity", r"setmore", r"""class=["'].*book""", r"""id=["'].*book"""),
    "has_live_chat": (r"intercom", r"zendesk", r"freshdesk", r"drift", r"olark", r"livechat", r"crisp\.chat", r"gorgias", r"""class=["'].*chat""", r"""id=["'].*chat"""),
    "has_pricing": (r"""<section[^>]*id=["']pricing""", r"""<div[^>]*class=["']pricing""", r"\$\d+", r"pricing table", r"price\s+list", r"subscription\s+plan"),
    "has_team_page": (r"""<section[^>]*id=["']team""", r"""<div[^>]*class=["']team""", r"meet\s+(the\s+)?team", r"our\s+leadership", r"staff\s+members"),
    "has_faq": (r"""<section[^>]*id=["']faq""", r"""<div[^>]*class=["']faq""", r"frequently\s+asked\s+questions", r"accordion"),
    "has_careers": (r"""<a[^>]*href=["'][^"']*careers""", r"""<a[^>]*href=["'][^"']*jobs""", r"join\s+our\s+team", r"we.{0,10}?hiring"),
    "has_whatsapp": (r"wa\.me", r"whatsapp", r"""class=["'].*whatsapp""", r"""id=["'].*whatsapp"""),
    "has_analytics": (r"google-analytics", r"gtag\.js", r"_gat\.", r"_ga\."),
    "has_crm": (r"hubspot", r"salesforce", r"pipedrive", r"zoho"),
    "has_marketing_pixels": (r"facebook\.com/tr", r"facebook.com/ads", r"pixel\.quantserve", r"google\.com/ads", r"doubleclick"),
    "has_multiple_locations": (r"multiple\s+location", r"locations?\s+worldwide", r"global\s+presence", r"international"),
}
CONTACT_FORM_WORDS = ("contact", "message", "inquiry", "email")
SCRIPT_WORDS = {"has_booking": ("calendly", "acuity", "setmore", "booking"), "has_live_chat": ("intercom", "zendesk", "drift", "olark")}
SECTION_ID_PATTERNS = {"has_pricing": "pricing", "has_team_page": "team|staff", "has_faq": "faq"}
SOCIAL_WORDS = ("facebook", "instagram", "twitter", "linkedin", "youtube", "tiktok")
FEATURES = (
    "has_contact_form", "has_booking", "has_live_chat", "has_pricing", "has_team_page", "has_faq", "has_careers", "has_whatsapp",
    "has_analytics", "has_crm", "has_marketing_pixels", "has_social_links",
)
TEAM_PAGE_PATTERNS = (r"our\s+team", r"meet\s+(?:the\s+)?team", r"team\s+members?", r"staff\s+directory", r"leadership", r"about\s+us")
KEY_FEATURES = (
    ("Live Chat Support", "has_live_chat"), ("Booking System", "has_booking"), ("Contact Form", "has_contact_form"),
    ("Pricing Information", "has_pricing"), ("Team/Staff Directory", "has_team_page"), ("FAQ Section", "has_faq"),
    ("Multiple Locations", "has_multiple_locations"),
)
# --- forms, company, services, team --------------------------------------------
FORM_INTENTS = {
    "contact_form": r"contact|enquiry|inquiry|message|get.in.touch|reach.us",
    "booking_form": r"book|booking|appointment|schedule|calendly|acuity|demo",
    "newsletter_form": r"newsletter|subscribe|mailing.list|sign.?up",
}
CHAT_SIGNATURES = ("intercomcdn.com", "intercom.io", "zdassets.com", "zendesk.com", "js.driftt.com", "client.crisp.chat", "embed.tawk.to", "tawk.to")
ABOUT_SECTION = r"about|mission|vision|story|who-we-are|company"
SERVICE_SECTION = r"service|solution|product|offering|what-we-do|capabilities"
SERVICE_SKIP = (
    "home", "about", "contact", "blog", "login", "get started", "learn more", "read more", "click here", "sign up", "sign in", "menu",
    "close", "open", "search", "back",
)
TEAM_SECTION = r"team|staff|about|leadership"
TEAM_CARD = r"card|member|person|bio|team-"
TITLE_WORDS = (
    "founder", "ceo", "cto", "cfo", "developer", "designer", "manager", "engineer", "director", "lead", "coach", "trainer",
    "consultant", "analyst", "specialist", "coordinator", "associate", "officer",
)
ADDRESS_SECTION = r"contact|address|location"
# --- structured data -------------------------------------------------------------
SCHEMA_TYPES = (
    "organization", "localbusiness", "person", "corporation", "professionalservice", "medicalorganization", "restaurant", "hotel", "store",
)
CLEAN_SCHEMA_TYPES = (
    "organization", "localbusiness", "person", "medicalorganization", "dentist", "restaurant", "hotel", "store", "professionalservice",
)
# --- confidence ------------------------------------------------------------------
BASE_CONFIDENCE = {"schema": 0.99, "mailto": 0.95, "tel": 0.93, "footer": 0.85, "form": 0.80, "visible": 0.75, "regex": 0.50, "unknown": 0.30}
# --- cleaning --------------------------------------------------------------------
BOILERPLATE = (
    "cookie", "privacy policy", "terms of service", "terms of use", "newsletter", "subscribe", "contact us", "get in touch", "follow us",
    "sitemap", "back to top", "marketing consent", "gdpr", "ccpa", "all rights reserved", "copyright", "unsubscribe", "contact details",
    "opening hours", "menu", "navigation",
)
UI_HEADINGS = (
    "follow us", "menu", "sitemap", "get in touch", "contact details", "opening hours", "follow", "share", "newsletter", "subscribe",
    "back to top", "cookie", "privacy", "terms", "legal", "contact us",
)
DISCARD_PHRASES = (
    "accessibility", "wcag", "screen reader", "keyboard navigation", "cookie", "tracking", "marketing cookie", "consent management",
    "privacy notice", "privacy policy", "terms of service", "terms of use", "cookie policy", "legal notice", "disclaimer", "copyright",
    "all rights reserved", "unsubscribe", "opt-out", "do not sell", "gdpr", "ccpa", "data protection", "visitor agreement",
)
NAV_KEEP = (
    "about", "services", "treatments", "pricing", "contact", "team", "emergency", "book", "appointment", "locations", "faq", "blog",
    "resources", "gallery", "portfolio", "products", "solutions", "features", "why-us", "testimonials", "case-studies", "careers",
)
NAV_SKIP = (
    "privacy", "terms", "cookie", "cookies", "complaints", "accessibility", "rss", "author", "category", "archive", "tag", "sitemap",
    "legal", "disclaimer", "security", "consent", "gdpr", "ccpa", "unsubscribe",
)
HOURS_PATTERN = r"(Mon|Tue|Wed|Thu|Fri|Sat|Sun)|\d{1,2}:\d{2}|(Closed|Open)"
HOURS_NOT = ("Dr ", "PhD", "DDS", "MD", "BSc")
DISCOVERY_METHOD = "sitemap + homepage crawl + internal links"
