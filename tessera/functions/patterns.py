"""Patterns and tables that the results depend on, and their form for Spark's regex engine.

The dialect is that of ECMAScript: \\b is ASCII, case folding is Unicode.  Java's \\b is not ASCII, so
``java`` spells it out; the SQL of the tests uses the patterns as they stand.
"""

# Fixed values
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+|00)[\d\s().-]{8,22}|\(\d{3}\)\s?\d{3}[-.\s]?\d{4}|\d{3}[-.\s]\d{3}[-.\s]\d{4}"
LINKEDIN = r"(?:https?://)?(?:www\.)?linkedin\.com/(?:in|company)/[A-Za-z0-9_-]+"
XING = r"(?:https?://)?(?:www\.)?xing\.com/(?:profile|pages)/[A-Za-z0-9._-]+"
WECHAT = r"(?:wechat|微信)[:\s]+([A-Za-z0-9_-]{4,20})"
ROLE_HINTS = r"\b(chief|ceo|cto|cfo|coo|chairman|chairwoman|president|founder|director|vp|vice president|head of|managing director|board|officer|vorstand|vorsitzende[rn]?|geschäftsführer(?:in)?|geschäftsführung|代表取締役|取締役|執行役員|社長)\b"
STAMP_ROLE_HINTS = r"\b(chief|ceo|cto|cfo|coo|chairman|chairwoman|president|founder|director|vp|vice president|head of|managing director|board|officer|vorstand|vorsitzende|geschäftsführer|代表取締役|取締役|執行役員|社長)\b"
EXECUTIVE_TITLE = r"(?:\b(?:chief|ceo|cto|cfo|coo|cro|cmo|cpo|president|founder|co-founder|director|vp|vice president|head of|managing director|partner|general manager|principal|board member|officer)\b|vorstand|geschäftsführer(?:in)?|geschäftsführung|vorsitzende[rn]?|代表取締役|取締役|執行役員|社長|会長)"
RECRUITING = r"\b(we're hiring|open positions?|apply now|view openings?|join (?:us|the team)|salary|full-time|part-time|remote)\b"
BANNED_NAMES = [
    "products", "product", "solutions", "solutions overview", "platform", "services", "pricing", "resources", "careers", "we are hiring", "jobs",
    "company", "about", "about us", "leadership", "executive team", "contact", "contact us", "blog", "press", "media", "privacy", "terms", "cookie policy",
    "security", "compliance", "login", "portal", "dashboard", "learn more", "get started", "read more", "whitepapers", "case studies", "faqs", "help center",
    "customer stories", "integrations", "documentation", "api", "overview", "enterprise",
]
HEADER_WORD = r"^(address|contact|email|phone|impressum|leadership|team|about)$"
NAME_WORDS = r"^[\p{L}\p{M}.·'’\-]+(?:\s+[\p{L}\p{M}.·'’\-]+)*$"
NAME_WORDS_STRICT = r"^[\p{L}\p{M}.'’\-]+(?:\s+[\p{L}\p{M}.'’\-]+)*$"
EXEC_BOLD = r"(?m)^[-*]\s+\*\*(.+?)\*\*\s+[—–-]\s+(.+?)(?:\s+[—–-]\s+(\S+@\S+))?$"
EXEC_DASH = r"(?m)^(?:[-*]\s+)?([\p{L}\p{M}.·'’\-\s]{2,80}?)\s+[—–-]\s+([^\n@]+?)(?:\s+[—–-]\s+(\S+@\S+))?\s*$"
EXEC_COMMA = r"(?m)^(?:[-*]\s+)?([\p{L}\p{M}.·'’\-\s]{2,80}),\s+([^\n,@]{2,80})$"
ADDRESS_LABELLED = r"(?:(?:Primary\s+|Global\s+|Regional\s+|European\s+|Headquarters\s+|HQ\s+|Corporate\s+)?(?:Address|Headquarters|HQ|Office|Location|Standort|Anschrift|本社|支社)(?:\s+(?:Address|Location|Office|Standort))?[:\s]+)([^\n\r]+)"
ADDRESS_POSTAL = r"(?:〒\s*\d{3}-?\d{4}[^\n\r]+|\d{4,5}\s+[A-ZÄÖÜ][a-zäöüß]+[^\n\r]+|\b\d{1,5}\s+[A-Za-z0-9\s.,-]+(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Drive|Dr|Way|Lane|Ln|Square|Sq|Plaza|Friedrichstraße|Straße|str\.)[A-Za-z0-9\s.,\d-]*\b)"
ADDRESS_FALLBACK = r"(?:〒\s*\d{3}-?\d{4}[^\n]+|\d{3,5}\s+[A-ZÄÖÜ][a-zäöüß]+[^\n]+|Address:\s*(.+)|Headquarters[:\s]+(.+))"
# what every address by the first and third pattern, and by the second, holds
ADDRESS_WORDS = ("address", "headquarters", "hq", "office", "location", "standort", "anschrift", "本社", "支社")
ADDRESS_NUMBER = r"〒|\d\s"
# how every address by the first pattern begins, in all that its case folding takes for these letters
ADDRESS_START = r"(?-iu:(?=[PpGgRrEeHhCcAaOoLlSsſ][RrLlEeUuOoDdFfTtNn][IiıİOoGgRrAaDdFfCcSsſ][MmBbIiıİOoDdPpRrAaNnCc]|[Hh][Qq]|[本支]社))"
NON_PERSON = r"^(products?|solutions?|about(\s+us)?|careers?|blog|faqs?|contact(\s+us)?|customers?|features?|pricing|services?|integrations?|resources?|documentation|docs|support|privacy(\s+policy)?|terms(\s+of\s+service)?|security|login|sign\s*in|sign\s*up|get\s*started|platform|overview|company)$"
FEATURE_METRIC = r"\b(\d+%\s*(?:gain|increase|reduction|growth|efficiency)|payment\s+processing|automated\s+multi-currency|settlement)\b"
NO_REPLY = r"noreply|no-reply|donotreply"
PLACEHOLDER = r"^(?:email|yourname|name|test|user)@(example|domain|placeholder|yourcompany)\.com$"
BORING = r"cookie|copyright|rights reserved|privacy"
GREETING = r"^(Welcome to\s+|At\s+[^,]+,\s*)"
FIELDS = {
    "company_name": "Company", "legal_name": "Legal name", "industry": "Industry", "description": "Profile", "address": "Address", "email": "Email",
    "phone": "Phone", "website": "Website", "linkedin": "LinkedIn", "xing": "Xing", "wechat": "WeChat",
}
LEGAL_FORM = r"gmbh|ag\b|inc\.|llc|ltd|株式会社"
GERMAN = r"\b(und|für|gesellschaft|straße)\b"
LANGUAGE_NAMES = {"en": "English", "de": "Deutsch", "ja": "日本語", "es": "Español", "fr": "Français", "zh": "中文", "ko": "한국어"}
PATH_TRAP = r"(?:login|signin|signup|register|auth|cart|checkout|wishlist|subscribe|feed|search|wp-admin|wp-content)\b"
# the legal/impressum exception is a second pattern, since RE2 has no lookahead
LINK_TRAP = r"/(?:blog|news|articles?|posts?|tag|tags|category|categories|privacy(?:-policy)?|terms(?:-of-service|-of-use|-and-conditions)?|cookies?(?:-policy)?|imprint|disclaimer|sitemap|rss|feed|login|signin|sign-in|signup|sign-up|register|auth|cart|checkout|shop|store|product-category|events|webinars?|podcast|whitepapers?|case-studies|faq|help|support|status)\b"
LEGAL_TRAP, LEGAL_ALLOWED = r"/legal\b", r"/legal/impressum"
TEXT_TRAP = r"\b(privacy\s+policy|terms\s+of\s+service|terms\s+of\s+use|cookie\s+policy|cookie\s+settings|legal\s+notice|all\s+rights\s+reserved|site\s*map|user\s+agreement|help\s+center|support\s+portal|log\s*in|sign\s*in|sign\s*up|my\s+account|shopping\s+cart|checkout|subscribe|rss\s+feed|read\s+our\s+blog|latest\s+news|white\s*papers?|case\s+studies)\b"
TAXONOMY = [
    ("leadership", 0.96, r"\b(leadership|team|executives?|board|management|directors|vorstand|leitung|役員|リーダー|経営|people)\b|(/(?:team|leadership|executives|board|management|directors|vorstand)\b)"),
    ("locations", 0.90, r"\b(locations?|offices?|branches|headquarters|standorte|standort|拠点|支社|本社)\b|(/(?:locations?|offices?|branches|standort(?:e)?)\b)"),
    ("company", 0.88, r"\b(company|corporate|firm|unternehmen|会社概要|企業情報)\b|(/(?:company|corporate|firm|unternehmensprofil)\b)"),
    ("about", 0.82, r"\b(about|about\s+us|über\s+uns|ueber-uns|who\s+we\s+are|profile)\b|(/(?:about(?:-us)?|ueber-uns|profile)\b)"),
    ("contact", 0.76, r"\b(contact|contact\s+us|impressum|kontakt|お問い合わせ)\b|(/(?:contact(?:-us)?|impressum|kontakt)\b)"),
]
INTENTS = [
    ("executives", 0.50, r"\b(leadership|team|executives?|board|management|directors?|founders?|vorstand|leitung|officers?|people|役員|リーダー|経営)\b"),
    ("addresses", 0.46, r"\b(locations?|offices?|branches|headquarters|standort[e]?|find-us|directions?|kontakt|anfahrt|拠点|支社|本社)\b"),
    ("emails", 0.45, r"\b(contact|contact-us|impressum|kontakt|support|get-in-touch|お問い合わせ)\b"),
    ("phone_numbers", 0.45, r"\b(contact|call-us|hotline|support|offices?|phone|tel)\b"),
    ("description", 0.40, r"\b(about|about-us|company|overview|story|who-we-are|profile|über-uns|ueber-uns|会社概要|企業情報)\b"),
]
DEPARTMENTS = [
    ("careers", r"\b(career|careers|jobs|hr|talent|recruit|recruiting)\b|career"),
    ("billing", r"\b(billing|invoice|account)\b|billing"),
    ("press", r"\b(press|media|pr|news)\b|press"),
    ("sales", r"\b(sales|deals|commercial|pricing)\b|sales"),
    ("support", r"\b(support|help|service|care|customer-care|customercare)\b|support|helpdesk"),
    ("legal", r"\b(legal|privacy|compliance)\b"),
]
ASSETS = (
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "tar", "gz", "7z", "dmg", "iso", "png", "jpg", "jpeg", "gif", "svg", "webp", "ico",
    "mp3", "mp4", "wav", "avi", "mov", "webm", "css", "js", "json", "xml", "rss",
)
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "ref", "source",
    "session_id", "sessionid", "sid", "phpsessid", "jsessionid",
)
#: (pattern, replacement with $1, $2) in order
SANITIZE = [
    *((rf"(?is)<{tag}.*?</{tag}>", "") for tag in ("script", "style", "noscript", "iframe", "svg", "canvas")),
    (r'(?i) on[a-z]+="[^"]*"', ""), (r'(?i) style="[^"]*"', ""),
    (r"""(?i)<img[^>]*(?:width=["']1["']|height=["']1["'])[^>]*>""", ""),
    (r"(?i)<link[^>]*>", ""), (r"(?s)<!--.*?-->", ""),
]
MARKDOWN = [
    *((rf"(?is)<h{k}[^>]*>(.*?)</h{k}>", "#" * k + " $1\n\n") for k in (1, 2, 3)),
    (r"(?i)<br\s*/?>", "\n"), (r"(?is)<li[^>]*>(.*?)</li>", "- $1\n"),
    (r"""(?is)<a[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>""", "[$2]($1)"),
    (r"(?i)<(?:p|div|section|article|header|footer|address)[^>]*>", "\n"),
    (r"(?i)</(?:p|div|section|article|header|footer|address)>", "\n\n"),
    (r"<[^>]+>", ""), (r"&amp;", "&"), (r"&nbsp;", " "), (r"\n{3,}", "\n\n"),
]
SANITIZE_DOM = [
    *((rf"(?is)<{tag}\b.*?</{tag}>", "") for tag in ("script", "style", "noscript", "iframe", "svg", "canvas", "video", "audio")),
    (r"""(?is) on[a-z]+=(?:"[^"]*"|'[^']*')""", ""), (r"""(?is) style=(?:"[^"]*"|'[^']*')""", ""),
    (r"""(?i)<img[^>]*\s(?:width|height)=["']?[12]["']?[^0-9a-z][^>]*>""", ""), (r"(?i)<(?:link|meta)[^>]*>", ""), (r"(?s)<!--.*?-->", ""),
]
ROOT = r"(?is)<(?:body|main|article)[^>]*>(.*)</(?:body|main|article)>"
LANG_ATTRIBUTE = r"""(?is)<html[^>]*\slang=["']([^"']+)["']"""
ANCHOR = r"""(?is)<a[^>]+href=["']([^"']+)["'][^>]*>(.*?)</a>"""
# End of fixed values

_RARE = r"""(?i)[< ](?:(?<=<)(?:noscript|iframe|svg|canvas|img|link)|(?<= )(?:on[a-z]+|style)=")"""
_LATER_HEADING = r"(?i)<h[23]"
#: What a text must hold for a step of SANITIZE or MARKDOWN to change it: a pattern, or one of LITERAL as it stands.
LITERAL = ("<!--", "&amp;", "&nbsp;", "\n\n\n")
NEEDS = {pattern: _RARE for pattern, _ in SANITIZE[2:10]} | {pattern: _LATER_HEADING for pattern, _ in MARKDOWN[1:3]} | {SANITIZE[10][0]: LITERAL[0]} | {pattern: x for (pattern, _), x in zip(MARKDOWN[-3:], LITERAL[1:])}

_ASCII_BOUND = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java(pattern: str) -> str:
    """A case-blind pattern for Spark."""
    return "(?iu)" + pattern.replace(r"\b", _ASCII_BOUND)
