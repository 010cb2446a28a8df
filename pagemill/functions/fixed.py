"""Lists, tables and limits that results must agree on.

Everything here is data the results depend on; the logic that uses it is in the other modules.
"""

# Query keys dropped on normalisation, besides every key that begins with utm_.
TRACKING_KEYS = ["fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ref", "ref_src", "_ga", "_gl"]

# Hosts that keep their scheme.
LOCAL_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0"]

# Query keys that always block a url.
BLOCKED_QUERY_KEYS = [
    "tag", "tags", "category", "cat", "search", "q", "s", "submit", "keywords", "city", "filter", "sort", "author", "lang", "language",
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "replytocom", "share", "print",
]
# Query keys let through when queries are not followed, one key at most.
ALLOWED_QUERY_KEYS = ["id", "slug", "post", "p"]

# Schemes of links that are no pages; spellings of hrefs that lead nowhere.
BLOCKED_SCHEMES = ["javascript:", "mailto:", "tel:", "sms:", "data:", "blob:", "whatsapp:", "skype:"]
PLACEHOLDER_HREFS = ["#", "", "#!", "javascript:void(0)", "javascript:void(0);", "javascript:;"]

# Endings of paths that are files, path segments of assets and of systems.
ASSET_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "pdf", "zip", "rar", "7z", "mp4", "mp3", "avi", "mov", "css", "js", "xml", "json", "woff", "woff2",
    "ttf", "eot", "map", "gz", "tar", "dmg", "exe", "apk",
]
ASSET_SEGMENTS = ["asset", "assets", "static", "media", "images", "img", "css", "js", "fonts", "font", "uploads", "cdn", "vendor", "dist", "build", "public"]
SYSTEM_SEGMENTS = ["admin", "wp-admin", "wp-json", "cgi-bin", "ajax", "api", "webhook", "_next", "_nuxt", "__webpack"]

# Server scripts whose path holds one of the words are actions.
ACTION_EXTENSIONS = ["php", "asp", "aspx", "jsp", "cgi"]
ACTION_WORDS = [
    "send", "submit", "contact", "mail", "form", "enquiry", "inquiry", "callback", "newsletter", "subscribe", "login", "logout", "register",
    "cart", "checkout", "payment", "order", "webhook",
]
MOST_SEGMENTS = 12

# First path parts of detail routes (a further segment must follow), the first that is found counts.
DETAIL_ROUTES = [
    ("blog_detail", "blog|article|articles|news|post|posts|stories|insights|resources|guides|whitepapers|press-releases?|announcements?"),
    ("blog_detail", "blog-details?|article-details?|news-details?|post-details?|story-details?"),
    ("job_detail", "career-details?|job-details?|opening-details?|vacancy-details?"),
    ("job_detail", "jobs?|career|careers|positions?|openings?|vacancies?|vacancy|job-openings?"),
    ("service_detail", "service-details?|solution-details?|product-details?"),
    ("service_detail", "services?|solutions?|offerings?|products?|capabilities"),
    ("portfolio_detail", "portfolio|case-studies?|case-study|projects?|work|our-work"),
    ("portfolio_detail", "success-stories?|success-story"),
    ("team_detail", "team|people|about/team|our-team"),
    ("event_detail", "events?|webinars?|workshops?"),
    ("doc_detail", "docs?|documentation|help|support|knowledge-?base|faq"),
]
# Whole paths of listing routes.
LISTING_ROUTES = [
    ("blog_listing", "blog|articles?|news|posts?|insights?|resources?"),
    ("job_listing", "jobs?|careers?|openings?|positions?|vacancies?|job-openings?"),
    ("service_listing", "services?|solutions?|products?|offerings?"),
    ("portfolio_listing", "portfolio|case-studies?|case-study|projects?|work"),
    ("portfolio_listing", "success-stories?|success-story"),
    ("team_listing", "team|people|our-team"),
    ("about", "about|about-us"),
    ("contact", "contact|contact-us|get-in-touch|reach-us"),
    ("legal", "privacy|privacy-policy|terms|terms-of-service|terms-and-conditions|cookie-policy|terms-condition"),
]
# Paths that a canonical link may wrongly point to.
GENERIC_PARENTS = (
    "blog-details?|article-details?|news-details?|post-details?|story-details?|service-details?|solution-details?|product-details?|"
    "career-details?|job-details?|opening-details?|vacancy-details?|blog|blogs|article|articles|news|posts?|insights?|resources?|services?|solutions?|"
    "products?|offerings?|careers?|jobs?|openings?|vacancies?|job-openings?|portfolio|case-studies?|success-stories?|projects?|work"
)
DISCOVERY_ROUTES = ["home", "section", "blog_listing", "job_listing", "service_listing", "portfolio_listing", "team_listing", "about", "general"]

# Points of a candidate's source (any other: 10) and of its route.
SOURCE_POINTS = {
    "start": 100, "sitemap": 40, "onclick_attr": 35, "nav_hover": 50, "click_revealed": 42, "nav_click_revealed": 58, "card_click_revealed": 52,
    "popup_click_revealed": 50, "hash_nav": 38, "spa_routing": 62, "json_ld": 45, "meta_refresh": 30, "canonical": 28, "dom_post_interaction": 20,
    "html_regex": 18, "dom": 15, "html_pattern": 12,
}
OTHER_SOURCE_POINTS = 10
ROUTE_POINTS = {"blog_detail": 32, "job_detail": 38, "service_detail": 32, "portfolio_detail": 30, "team_detail": 22, "event_detail": 28, "doc_detail": 25, "general_detail": 18}
USEFUL_ANCHORS = ["details", "read more", "learn more", "view", "case study", "opening", "job", "career", "service", "solution", "product", "portfolio", "resource", "whitepaper", "guide", "report"]
LOW_VALUE_PATHS = ["privacy", "terms", "cookie", "login", "register", "cart", "checkout", "search", "tag", "category", "author", "feed", "print"]
LEAST_SCORE = -30

# Parts of addresses of trackers.
TRACKERS = [
    "google-analytics.com", "googletagmanager.com", "doubleclick.net", "googlesyndication.com", "googleadservices.com", "adservice.google.com",
    "facebook.net", "connect.facebook.net", "facebook.com/tr", "hotjar.com", "clarity.ms", "segment.com", "segment.io", "mixpanel.com", "intercom.io",
    "widget.intercom.io", "hs-scripts.com", "hs-analytics.net", "hubspot.com", "crisp.chat", "tawk.to", "amazon-adsystem.com", "criteo.com", "taboola.com",
    "outbrain.com", "bing.com/bat", "linkedin.com/px", "snapchat.com", "tiktok.com/i18n", "newrelic.com", "nr-data.net", "sentry.io", "bugsnag.com",
]
HEAVY_RESOURCES = ["image", "media", "font", "stylesheet"]

# Agents whose robots rules are followed.
ROBOTS_AGENTS = ["*", "Googlebot", "crawler", "bot"]

# Places of sitemaps; most sitemaps read.
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap.xml.gz", "/server-sitemap.xml", "/sitemap-0.xml", "/sitemap-pages.xml"]
MOST_SITEMAPS = 100

# Attributes that hold a link, in their order.
LINK_ATTRIBUTES = ["href", "data-href", "data-url", "data-link", "router-link", "routerlink", "ng-href"]

# Limits of what is done on a page, and the words of labels that are not clicked.
MOST_BUTTONS, MOST_NAVIGATIONS, MENU_DEPTH, CLICK_DEPTH, DETAIL_BUTTONS, DETAIL_NAVIGATIONS, MOST_FRAGMENTS = 80, 60, 6, 6, 8, 4, 25
HANDLER_TEXT_CHARS, LABEL_CHARS, ARIA_CHARS = 100, 120, 80
NOISE_LABELS = [
    "cookie", "accept", "agree", "consent", "got it", "dismiss", "close", "login", "sign in", "sign up", "register", "share", "facebook", "twitter", "linkedin",
    "print", "cart", "checkout", "buy", "subscribe", "newsletter", "theme", "dark mode", "light mode", "language", "translate", "back to top", "scroll",
]
BETWEEN_DIALOGS = "\n\n---\n\n"
# The stages of discovery on a page, in their order.
STAGES = ["nav_hover", "click", "hash", "spa", "onclick", "dom", "html", "json_ld", "meta_refresh"]

# Lines and image texts of user interfaces.
UI_PHRASES = [
    "read more", "learn more", "view more", "view all", "view details", "click here", "submit", "send", "send message", "apply now", "explore",
    "explore more", "get started", "back to top", "next", "previous", "prev", "share", "follow us", "subscribe", "newsletter",
]
IMAGE_NOISE = ["image", "img", "icon", "logo", "shape", "banner", "avatar", "photo", "calendar", "location", "mail", "email", "phone", "arrow", "angle", "partners"]
SOCIAL_NAMES = ["facebook", "twitter", "x", "linkedin", "instagram", "youtube", "whatsapp"]
ASSET_LINE_FOLDERS = "asset|assets|static|uploads|images|img|css|js|fonts?"
ASSET_LINE_ENDINGS = "png|jpe?g|webp|gif|svg|css|js|woff2?|ttf|ico"

# What makes a page poor.
BAD_TITLES = ["404 not found", "page not found", "access denied", "forbidden", "server error", "method not allowed", "503 service"]
BAD_PHRASES = ["404 not found", "page not found", "method not allowed", "invalid request", "access denied", "forbidden", "503 service unavailable"]
BAD_PHRASE_CHARS = 800
JOB_WORDS = [
    "experience", "responsibilities", "requirements", "qualifications", "skills", "location", "employment type", "job description", "apply", "role",
    "position", "vacancy", "opening", "salary", "compensation", "benefits", "contract", "permanent", "full-time", "part-time",
]
LEAST_JOB_WORDS, JOB_DETAIL_CHARS, LEAST_PAGE_WORDS, MANY_WORDS, LEAST_DISTINCT_SHARE = 2, 400, 15, 80, 0.05
LEAST_CHARS, LEAST_DETAIL_CHARS = 120, 250

# Where a page's content is looked for, and what is taken out before.
CONTENT_SELECTORS = [
    "main article", "article", "main", "[role='main']", ".post-content", ".entry-content", ".article-content", ".article-body", ".blog-content",
    ".blog-detail", ".blog-details", ".post-body", ".story-body", ".news-content", ".news-detail", ".news-body", ".job-content", ".job-detail",
    ".job-details", ".career-content", ".career-detail", ".career-details", ".position-content", ".service-content", ".service-detail",
    ".service-details", ".product-content", ".solution-content", ".main-content", ".page-content", ".content-area", ".content-wrapper",
    ".content-body", ".content-inner", ".single-content", ".single-post", ".detail-content", ".details-content", ".section-content", "#content",
    "#main", "#main-content", "#page-content", "body",
]
NOISE_SELECTORS = [
    "script", "style", "noscript", "iframe", "svg", "canvas", "nav", "footer", "header", "form", "aside", "[class*='sidebar']", "[class*='widget']",
    "[class*='related']", "[class*='recent-post']", "[class*='popular-post']", "[class*='breadcrumb']", "[class*='tag-cloud']",
    "[class*='social-share']", "[class*='share-btn']", "[class*='share-box']", "[class*='cookie']", "[class*='consent']", "[class*='gdpr']",
    "[class*='newsletter']", "[class*='subscription']", "[id*='sidebar']", "[id*='related']", "[id*='cookie']", "[id*='social']", "[id*='share']",
    "[class*='advertisement']", "[class*='ads-']", "[id*='google-ads']", "[class*='comment']", "#comments", ".disqus-container", "[class*='sticky']",
    "[class*='fixed-']", "[class*='floating']",
]
HEADING_SELECTORS = ["h1", "h2.page_title", "h2.details_item_title", "h2[class*='title']", "h3.post_title", "h3[class*='title']", "h2", "h3"]
ENOUGH_CONTENT = 2000
# Content selectors at which the search never ends; keys of linked data that hold addresses, themselves or below.
WIDE_SELECTORS = ["body", "#content", "#main"]
LINKED_DATA_KEYS, LINKED_DATA_KEYS_BELOW = ["@id", "url", "mainEntityOfPage"], ["@id", "url"]

# Sending pages, jobs and rates.
ERROR_CHARS, MOST_LOADS = 200, 2
RETRIED_STATUSES, MOST_ATTEMPTS = [0, 408, 429, 500, 502, 503, 504], 4
ABORT_AFTER, ABORT_RATE = 5, 0.8
RATE_REQUESTS, RATE_SECONDS = 30, 60
ACTIVE_STATUSES, FINAL_STATUSES, MOST_ACTIVE, JOB_SECONDS = ["QUEUED", "PROCESSING"], ["COMPLETED", "COMPLETED_WITH_ERRORS", "FAILED"], 10, 7200

# Patterns of links in raw HTML, in their order; of navigation in click handlers; of handlers' quoted arguments.
SOURCE_LINK_PATTERNS = [
    r"""href=['"]((?!javascript:|mailto:|#)[^'"]+)['"]""",
    r""""path"\s*:\s*"([^"]+)\"""",
    r""""url"\s*:\s*"(https?://[^"]+)\"""",
    r"""['"](/[a-zA-Z0-9\-_][a-zA-Z0-9\-_/]*)['"]""",
]
SCRIPT_TARGET_PATTERN = r"""(?:location\.href|location\.assign|location\.replace|window\.location(?:\.href)?|window\.open)\s*[=(]\s*['"]([^'"]+)['"]"""
FORM_HANDLER_PATTERN = r"""submitForm\d*\s*\(\s*event\s*,\s*['"]([^'"]+)['"]\s*,\s*['"]([^'"]*)['"]\s*,\s*['"]([^'"]+)['"]\s*\)"""
PLAIN_FORM_HANDLER_PATTERN = r"""submitForm\s*\(\s*event\s*,\s*['"]([^'"]+)['"]\s*,\s*['"]([^'"]*)['"]\s*,\s*['"]([^'"]+)['"]\s*\)"""
PATH_HANDLER_PATTERN = r"""(?:navigateTo|goToPage|gotoDetail|openDetail|viewItem)\s*\(\s*['"]([^'"]+)['"]\s*,\s*['"](/[^'"]+)['"]"""
QUOTED_PATH_PATTERN = r"""['"](/[a-zA-Z0-9\-_/]+/[a-zA-Z0-9\-_]+)['"]"""
LEAST_HANDLER_CHARS = 15

# Patterns of markdown and of addresses.
MARKDOWN_SIGNS = r"[*_`#>\-\[\]().,:;!|]+"
IMAGE_PATTERN = r"!\[([^\]]*)\]\(([^)]+)\)"
LINK_PATTERN = r"\[([^\]]+)\]\(([^)]+)\)"
SITEMAP_LOCATION = r"<loc>\s*(.*?)\s*</loc>"
REFRESH_TARGET = r"url=(.+)"
REVEALED_HEADING = "\n\n---\n\n# Click-Revealed Content\n\n"
