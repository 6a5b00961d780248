"""Fixed values the rules read: word lists, lookup tables, limits and message texts.

Everything in this module is a fixed value that has to be equal for results to be equal; there is no
logic here.  Lists are bounded (each has fewer than 200 entries), so they are embedded in expressions
as literals and are never joined or broadcast.
"""

# --- fixed values: geography --------------------------------------------------------------------
EU_TLD_COUNTRY = {
    "at": "Austria", "be": "Belgium", "bg": "Bulgaria", "hr": "Croatia", "cy": "Cyprus", "cz": "Czechia",
    "dk": "Denmark", "ee": "Estonia", "fi": "Finland", "fr": "France", "de": "Germany", "gr": "Greece",
    "hu": "Hungary", "ie": "Ireland", "it": "Italy", "lv": "Latvia", "lt": "Lithuania", "lu": "Luxembourg",
    "mt": "Malta", "nl": "Netherlands", "pl": "Poland", "pt": "Portugal", "ro": "Romania", "sk": "Slovakia",
    "si": "Slovenia", "es": "Spain", "se": "Sweden", "gb": "United Kingdom",
}
EU_CITIES = [
    "vienna", "linz", "graz", "brussels", "antwerp", "sofia", "plovdiv", "zagreb", "split",
    "nicosia", "prague", "brno", "copenhagen", "aarhus", "tallinn", "helsinki", "tampere",
    "paris", "lyon", "marseille", "berlin", "munich", "hamburg", "athens", "thessaloniki",
    "budapest", "dublin", "rome", "milan", "naples", "riga", "vilnius", "kaunas", "luxembourg",
    "valletta", "amsterdam", "rotterdam", "eindhoven", "warsaw", "krakow", "wroclaw", "lisbon", "porto",
    "bucharest", "cluj", "bratislava", "kosice", "ljubljana", "madrid", "barcelona", "valencia",
    "stockholm", "gothenburg", "malmo", "london", "manchester", "birmingham",
]
TLD_LANGUAGE = {
    "lt": "lt", "de": "de", "fr": "fr", "es": "es", "it": "it", "pl": "pl",
    "com": "en", "co": "en", "net": "en", "org": "en",
}
# Public two-label suffixes under which registrations happen one label further down.
TWO_LABEL_SUFFIXES = [
    "co.uk", "org.uk", "me.uk", "ac.uk", "gov.uk", "ltd.uk", "plc.uk", "net.uk", "sch.uk", "nhs.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "org.nz", "net.nz", "co.za", "org.za",
    "com.br", "net.br", "org.br", "co.jp", "ne.jp", "or.jp", "ac.jp", "co.kr", "or.kr", "com.cn",
    "net.cn", "org.cn", "com.tw", "com.hk", "com.sg", "com.my", "co.in", "net.in", "org.in", "co.il",
    "org.il", "com.tr", "com.mx", "com.ar", "com.co", "com.pl", "net.pl", "org.pl", "com.ua", "com.gr",
    "com.cy", "com.mt", "co.at", "or.at", "com.pt", "com.ro", "co.hu", "com.es", "org.es", "com.hr",
]
TEXT_COUNTRIES = ["lithuania", "latvia", "estonia", "poland", "germany", "france", "spain", "italy"]
CONTEXT_COUNTRIES = ["Lithuania", "Latvia", "Estonia", "Poland", "Germany", "France", "UK", "USA"]
ADDRESS_CITIES = [
    "Vilnius", "Kaunas", "Rīga", "Riga", "Tallinn", "Warsaw", "Warszawa", "Kraków", "Praha", "Praague",
    "Berlin", "Munich", "Paris", "Lyon", "Madrid", "Barcelona", "Lisboa", "Lisbon", "Roma", "Milano",
    "Amsterdam", "Rotterdam", "Brussels", "Antwerpen",
]
ADDRESS_WORDS = [r"street", r"str\.", r"ul\.", r"avenue", r"ave\.", r"road", r"rd\.", r"g\."]

# --- fixed values: page markers -----------------------------------------------------------------
BLOCK_PHRASES = [
    "attention required | cloudflare", "checking your browser before accessing",
    "please wait while we check your browser", "cloudflare", "captcha", "security check", "access denied",
    "blocked", "rate limited", "too many requests", "please enable javascript", "javascript is disabled",
]
BLOCK_PHRASES_STRICT = [
    "access denied", "blocked by", "captcha required", "cloudflare checking your browser", "rate limited",
    "too many requests", "please wait while we check your browser",
]
PLATFORM_MARKERS = {
    "wordpress": ["wp-content", "wp-includes", "wp-admin", "wordpress"],
    "shopify": ["shopify", "myshopify.com", "cdn.shopify.com"],
    "wix": ["wix.com", "wixstatic.com", "wixsite.com"],
    "hostinger": ["hostinger", "hpanel"],
    "squarespace": ["squarespace.com", "sqs-cdn.com"],
}
IMAGE_EXTENSIONS = [".img", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".svg", ".webp", ".avif"]
GENERIC_ANCHORS = ["click here", "page", "article"]
WEAK_ALTS = ["image", "img", "photo", "picture"]
TECHNICAL_PATTERNS = ["sitemap", "robots.txt", ".xml", "feed", "rss", "atom"]
TECHNICAL_EXTENSIONS = [".xml", ".txt", ".rss", ".atom"]
AI_CRAWLERS = ["gptbot", "chatgpt", "claude", "bingbot", "googlebot"]

# --- fixed values: questions and FAQ ------------------------------------------------------------
FAQ_WORDS = ["faq", "frequently asked", "questions", "answers", "q&a"]
FAQ_WORDS_WIDE = ["faq", "frequently asked", "questions", "answers", "q&a", "common questions"]
QUESTION_OPENERS = [
    "who", "what", "when", "where", "why", "how", "can", "does", "do", "is", "are", "should", "which",
    "kada", "kaip", "kodėl", "kas", "ar", "kur",
]
SENTENCE_OPENERS = ["What", "How", "Why", "When", "Where", "Can", "Is", "Are", "Do", "Does"]
SECTION_QUESTION_WORDS = ["what", "how", "why", "when", "where"]
META_QUESTION_WORDS = ["how", "what", "why", "when", "where"]
CONTENT_QUESTION_PHRASES = ["what is", "how to", "why", "when", "where"]
LIST_MARKERS = ["•", "-", "1.", "2.", "3."]
SNIPPET_MARKERS = ["•", "-", "1.", "2.", "3.", ":", ";"]
QUESTION_WORDS_BY_LANG = {
    "en": ["what", "how", "why", "when", "where", "who"],
    "es": ["qué", "cómo", "por qué", "cuándo", "dónde", "quién"],
    "fr": ["quoi", "comment", "pourquoi", "quand", "où", "qui"],
    "de": ["was", "wie", "warum", "wann", "wo", "wer"],
    "it": ["cosa", "come", "perché", "quando", "dove", "chi"],
}
FAQ_PROMPTS = {
    "en": ("What is {x}?", "How much does {x} cost?"),
    "lt": ("Kas yra {x}?", "Kiek kainuoja {x}?"),
    "lv": ("Kas ir {x}?", "Cik maksā {x}?"),
    "et": ("Mis on {x}?", "Kui palju maksab {x}?"),
    "pl": ("Co to jest {x}?", "Ile kosztuje {x}?"),
    "de": ("Was ist {x}?", "Wie viel kostet {x}?"),
    "fr": ("Qu'est-ce que {x} ?", "Combien coûte {x} ?"),
    "es": ("¿Qué es {x}?", "¿Cuánto cuesta {x}?"),
    "it": ("Che cos'è {x}?", "Quanto costa {x}?"),
    "nl": ("Wat is {x}?", "Wat kost {x}?"),
    "pt": ("O que é {x}?", "Quanto custa {x}?"),
    "ro": ("Ce este {x}?", "Cât costă {x}?"),
    "cs": ("Co je {x}?", "Kolik stojí {x}?"),
    "sk": ("Čo je {x}?", "Koľko stojí {x}?"),
    "hu": ("Mi az a {x}?", "Mennyibe kerül a {x}?"),
    "el": ("Τι είναι το {x};", "Πόσο κοστίζει το {x};"),
    "da": ("Hvad er {x}?", "Hvad koster {x}?"),
    "sv": ("Vad är {x}?", "Vad kostar {x}?"),
    "fi": ("Mikä on {x}?", "Kuinka paljon {x} maksaa?"),
    "ie": ("What is {x}?", "How much does {x} cost?"),
    "mt": ("X'inhu {x}?", "Kemm jiswa {x}?"),
    "bg": ("Какво е {x}?", "Колко струва {x}?"),
    "hr": ("Što je {x}?", "Koliko košta {x}?"),
    "sl": ("Kaj je {x}?", "Koliko stane {x}?"),
}
FAQ_ANSWER_HINTS = (
    "Add a concise answer in the site's language.",
    "Add a pricing note and call to action in the site's language.",
)

# --- fixed values: industry, language, topics ---------------------------------------------------
INDUSTRY_KEYWORDS = {
    "ecommerce": ["shop", "buy", "cart", "checkout", "product", "price", "sale", "store"],
    "saas": ["software", "app", "platform", "dashboard", "api", "integration", "trial", "subscription"],
    "local_business": ["near me", "local", "service", "contact", "address", "phone", "location"],
    "blog": ["blog", "article", "post", "guide", "tutorial", "tips", "learn", "how-to"],
    "corporate": ["company", "about", "services", "solutions", "team", "careers", "business"],
}
INDUSTRY_KEYWORDS_SHORT = {
    "ecommerce": ["shop", "buy", "cart", "checkout", "product", "price", "sale"],
    "saas": ["software", "app", "platform", "dashboard", "api", "integration", "trial"],
    "local_business": ["near me", "local", "service", "contact", "address", "phone"],
    "blog": ["blog", "article", "post", "guide", "tutorial", "tips", "learn"],
    "corporate": ["company", "about", "services", "solutions", "team", "careers"],
}
INDUSTRY_FIRST_KEYWORDS = {
    "perfume": ["perfume", "fragrance", "scent", "eau de toilette", "cologne"],
    "fashion": ["fashion", "clothing", "apparel", "style"],
    "beauty": ["beauty", "cosmetics", "makeup", "skincare"],
    "technology": ["software", "app", "tech", "digital", "platform"],
    "ecommerce": ["shop", "store", "buy", "purchase", "online"],
    "subscription": ["subscription", "monthly", "recurring", "membership"],
}
LT_MARKERS = ["ą", "č", "ę", "ė", "į", "š", "ų", "ū", "ž", "kur", "kaip", "kada", "kur", "kas", "kodėl"]
EN_MARKERS = [
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
    "what", "how", "when", "where", "why",
]
TOPIC_STOP_WORDS = [
    "this", "that", "with", "from", "they", "have", "been", "were", "said", "each", "which", "their", "time",
    "will", "about", "there", "could", "other", "after", "first", "well", "also", "where", "much", "some",
    "these", "would", "into", "has", "more", "very", "what", "know", "just", "over", "think", "back", "use",
    "two", "how", "our", "work", "life", "only", "can", "still", "should", "because", "through", "before",
    "here", "when", "take", "than", "its", "who", "oil", "sit", "now", "find", "long", "down", "day", "did",
    "get", "may", "say", "she", "her", "many", "come", "like", "make", "such", "them",
]
# Frequent function words, eight per language, for the token-count language guess.
LANGUAGE_WORDS = {
    "en": ["the", "and", "of", "to", "is", "with", "for", "that"],
    "lt": ["ir", "yra", "kad", "su", "iš", "kaip", "bet", "nuo"],
    "lv": ["un", "ir", "ar", "no", "kas", "par", "uz", "kā"],
    "et": ["ja", "on", "ei", "see", "oma", "kui", "mis", "aga"],
    "pl": ["jest", "nie", "się", "na", "że", "do", "jak", "co"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "mit", "sich"],
    "fr": ["le", "la", "les", "des", "et", "est", "dans", "que"],
    "es": ["el", "los", "las", "una", "por", "con", "para", "del"],
    "it": ["il", "di", "che", "sono", "della", "gli", "nel", "anche"],
    "nl": ["het", "een", "van", "niet", "zijn", "voor", "ook", "maar"],
    "pt": ["uma", "não", "com", "os", "mais", "dos", "ao", "pelo"],
    "ro": ["și", "este", "cu", "pe", "din", "care", "sunt", "pentru"],
    "cs": ["je", "že", "ale", "pro", "jsem", "jako", "tak", "při"],
    "sk": ["nie", "ako", "sme", "pre", "sú", "čo", "aj", "už"],
    "hu": ["az", "és", "egy", "hogy", "nem", "van", "csak", "mint"],
    "el": ["και", "το", "της", "του", "είναι", "για", "την", "με"],
    "da": ["og", "at", "er", "af", "til", "ikke", "den", "jeg"],
    "sv": ["och", "att", "det", "som", "är", "inte", "för", "på"],
    "fi": ["että", "hän", "mutta", "joka", "myös", "ovat", "niin", "kuin"],
    "mt": ["huwa", "minn", "għal", "dan", "jew", "hija", "biex", "ta"],
    "bg": ["на", "за", "се", "от", "да", "не", "като", "със"],
    "hr": ["koji", "kao", "što", "nije", "su", "ili", "sve", "kako"],
    "sl": ["ki", "tudi", "pri", "bil", "pa", "lahko", "kot", "bi"],
}
COMPARISON_KEYWORDS = [
    "competitor", "alternative", "vs", "compared to", "better than", "instead of", "similar to", "like",
    "such as",
]
COMPARISON_MARKERS = ["vs", "compared to", "alternative to", "better than"]
COMPARISON_WORDS = ["vs", "versus", "compared", "alternative", "competitor"]
PRODUCT_HEADING_WORDS = ["product", "service", "perfume", "subscription"]
PRODUCT_LINE_GATE = ["produktas", "paslauga", "prekė", "tarnyba", "produktai", "paslaugos"]
PRODUCT_LINE_WORDS = ["produktas", "paslauga", "prekė"]
PRODUCT_URL_WORDS = ["/product", "/products", "product", "shop", "price"]

# --- fixed values: score words ------------------------------------------------------------------
REVIEW_WORDS = [
    "review", "reviews", "testimonials", "★★★★★", "bewertung", "avis", "opinie", "recensies", "reseñas",
]
GEO_WORDS = ["city", "country", "region", "local", "near me", "in", "at"]
LOCAL_WORDS = ["service", "business", "company", "local", "near me"]

# --- fixed values: answers ----------------------------------------------------------------------
CATEGORY_WEIGHTS = {
    "brand": 1.0, "service_product": 1.5, "competitor": 2.0, "local_geo": 1.5, "problem_solving": 1.5,
}
STRONG_WORDS = [
    "best", "recommended", "top choice", "highly recommend", "excellent", "outstanding", "superior",
    "preferred", "leading", "premier",
]
WEAK_WORDS = [
    "one of many", "several options", "alternatives", "other choices", "also consider", "in addition",
    "besides", "along with",
]
COMPETITOR_INDICATORS = [
    "alternatives", "competitors", "other options", "similar services", "like", "such as", "including",
    "also", "besides", "in addition to",
]
NAME_STOP_WORDS = ["the", "and", "or", "but", "for", "with", "by"]

# --- fixed values: session steps ----------------------------------------------------------------
FUNNEL_STEPS = ["website", "site_health", "description", "prompts", "competitors", "analysis", "finishing"]

# --- fixed values: limits -----------------------------------------------------------------------
MAX_FAQ_PER_PAGE = 25
MAX_TOP_TASKS = 25
MAX_SITE_TASKS = 20
MAX_PAGE_TASKS = 3

# --- fixed values: query templates (id, category, only when the site has / lacks a location, text)
QUERY_TEMPLATES = [
    (1, "brand", None, "What is {brand}?"),
    (2, "brand", None, "How does {brand} work?"),
    (3, "brand", None, "Is {brand} reliable?"),
    (4, "brand", None, "What makes {brand} different?"),
    (5, "service_product", None, "Best {product} for businesses"),
    (6, "service_product", None, "How to choose {product}?"),
    (7, "service_product", None, "What are the top {product}?"),
    (8, "service_product", None, "Compare {product} options"),
    (9, "competitor", None, "{brand} vs competitors"),
    (10, "competitor", None, "Alternatives to {brand}"),
    (11, "competitor", None, "Best {product} providers"),
    (12, "competitor", None, "Compare {brand} with other options"),
    (13, "local_geo", True, "Best {product} in {location}"),
    (14, "local_geo", True, "{brand} in {location}"),
    (15, "local_geo", True, "Local {product} providers in {location}"),
    (16, "local_geo", True, "Where to find {brand} in {location}?"),
    (13, "service_product", False, "What are the benefits of {product}?"),
    (14, "service_product", False, "How much does {product} cost?"),
    (15, "service_product", False, "When should I use {product}?"),
    (16, "service_product", False, "What problems does {product} solve?"),
    (17, "problem_solving", None, "How to solve {industry} problems?"),
    (18, "problem_solving", None, "What are common {industry} challenges?"),
    (19, "problem_solving", None, "How to improve {industry} efficiency?"),
    (20, "problem_solving", None, "What solutions exist for {industry} issues?"),
]
DEFAULT_QUERIES = {
    "brand": [
        "What is {brand}?", "Is {brand} trustworthy?", "Best {industry} companies", "How does {brand} work?",
        "{brand} reviews",
    ],
    "context": [
        "What is {brand}?", "Is {brand} trustworthy?", "Best {brand} companies", "How does {brand} work?",
        "{brand} reviews",
    ],
    "page": [
        "What is {brand}?", "What services does {brand} offer?", "How can I contact {brand}?",
        "Where is {brand} located?", "What are {brand}'s main products?",
    ],
}
# (kind, position, repeats per product up to, needs, text, type, volume, difficulty, intent, potential, category)
AEO_TEMPLATES = [
    ("keyword", 1, 0, "brand", "what is {brand}", "brand_question", "high", "easy", "informational", "high",
     "brand_authority"),
    ("keyword", 2, 0, "brand", "how does {brand} work", "process_question", "medium", "medium", "informational",
     "high", "brand_authority"),
    ("keyword", 3, 3, None, "best {product}", "product_comparison", "high", "medium", "commercial", "high",
     "product_optimization"),
    ("keyword", 4, 3, None, "{product} guide", "product_guide", "medium", "easy", "informational", "high",
     "product_optimization"),
    ("keyword", 5, 0, "industry", "how to solve {industry} problems", "problem_solution", "medium", "medium",
     "informational", "high", "problem_solving"),
    ("question", 1, 2, None, "How to choose the best {product}?", "how_to", "high", "medium", "informational",
     "high", "tutorial"),
    ("question", 2, 2, None, "What to look for in {product}?", "evaluation", "medium", "easy", "informational",
     "high", "evaluation"),
    ("question", 3, 0, "competitor", "What makes {brand} better than {competitor}?", "comparison", "medium",
     "hard", "comparison", "medium", "competitive_analysis"),
    ("question", 4, 0, None, "What are the common {industry} challenges?", "problem_identification", "high",
     "easy", "informational", "high", "problem_solving"),
]
GEO_TEMPLATES = [
    ("keyword", 1, 0, "brand+location", "{brand} in {location}", "local_brand", "medium", "easy", "local",
     "high", "local_brand"),
    ("keyword", 2, 0, "brand+location", "best {brand} {location}", "local_best", "medium", "medium",
     "local_commercial", "high", "local_brand"),
    ("keyword", 3, 2, "location", "{product} in {location}", "local_service", "medium", "easy", "local", "high",
     "local_service"),
    ("keyword", 4, 2, "location", "local {product} {location}", "local_search", "low", "easy", "local",
     "medium", "local_service"),
    ("keyword", 5, 0, "competitor+location", "{brand} vs {competitor} {location}", "local_comparison", "low",
     "hard", "local_comparison", "medium", "local_competitive"),
    ("question", 1, 0, "location", "Where to find {brand} in {location}?", "local_where", "medium", "easy",
     "local", "high", "local_discovery"),
    ("question", 2, 0, "location", "Best {industry} services in {location}?", "local_best", "high", "medium",
     "local_commercial", "high", "local_services"),
    ("question", 3, 0, None, "What to expect from {brand} in {location}?", "local_experience", "low", "easy",
     "local_informational", "medium", "local_experience"),
    ("question", 4, 0, "location", "Common {industry} issues in {location}?", "local_problems", "medium", "easy",
     "local_informational", "high", "local_problem_solving"),
]
MAX_KEYWORDS = 6
MAX_QUESTIONS = 5
FALLBACK_PRODUCT = "services"

# --- fixed values: advice texts -----------------------------------------------------------------
SITE_ADVICE = {
    "faq_content": "Add FAQ sections with common customer questions",
    "faq_schema": "Implement FAQ schema markup (JSON-LD)",
    "other_schemas": "Add structured data markup (HowTo, Product, Organization)",
    "meta_description": "Optimize meta descriptions for featured snippets",
    "snippet_suitability": "Improve content structure for featured snippets",
    "question_headings": "Add question-style headings (What, How, Why)",
    "hreflang_tags": "Implement hreflang tags for multilingual targeting",
    "local_business_schema": "Add LocalBusiness schema markup",
    "nap_consistency": "Ensure NAP (Name, Address, Phone) consistency",
    "geo_meta_tags": "Add geographic meta tags",
    "map_embeds": "Add map embeds for location visibility",
}
QUICK_WINS = {
    "aeo": ["Add meta descriptions to pages missing them", "Add question-style headings to key pages"],
    "geo": ["Add hreflang tags to homepage", "Add LocalBusiness schema to contact page"],
}
# (signal, category, priority, title, description, action)
PAGE_ADVICE = [
    ("faq_content", "AEO", "high", "Add FAQ Content",
     "This page lacks FAQ content. Add Q&A sections to improve answer engine optimization.",
     "Create FAQ sections with common questions and answers"),
    ("meta_description", "AEO", "medium", "Optimize Meta Description",
     "Meta description needs optimization for featured snippets.",
     "Write concise, descriptive meta descriptions (150-160 characters)"),
    ("hreflang_tags", "GEO", "high", "Add Hreflang Tags",
     "Missing hreflang tags for geographic targeting.",
     "Add hreflang attributes to specify language and region targeting"),
    ("local_business_schema", "GEO", "medium", "Add Local Business Schema",
     "Missing LocalBusiness structured data for local SEO.",
     "Add LocalBusiness schema markup with NAP (Name, Address, Phone) information"),
]
VISIBILITY_ADVICE = {
    "low": ["Increase brand mentions in content for better AI recognition",
            "Add brand name to page titles and meta descriptions",
            "Create content that answers common questions about your brand"],
    "middle": ["Optimize existing content for better AI understanding",
               "Add structured data to help AI understand your brand",
               "Create FAQ content that AI can easily extract"],
    "high": ["Maintain current visibility and add more specific content",
             "Focus on long-tail questions and detailed answers"],
}

# --- fixed values: task, warning, advice and message texts, whole, with {slots} for values
TEXTS = {
    "image_missing_alt_tag": 'Image missing alt tag: {src}',
    "anchor_missing_title_tag": 'Anchor missing title tag: {href}',
    "anchor_text_contains_generic": 'Anchor text contains generic text: {text}',
    "keywords_should_be_avoided": 'Keywords should be avoided as they are a spam indicator and no longer used by Search Engines: {keywords}',
    "title_tag_is_too": 'Title tag is too short (less than 10 characters): {title}',
    "title_tag_is_too_long": 'Title tag is too long (more than 70 characters): {title}',
    "missing_title_tag": 'Missing title tag',
    "no_title": 'No Title',
    "missing_description_2": 'Missing description',
    "description_is_too_short": 'Description is too short (less than 140 characters): {meta}',
    "description_is_too_long": 'Description is too long (more than 255 characters): {meta}',
    "missing_og_title": 'Missing og:title',
    "missing_og_image": 'Missing og:image',
    "missing_og_description_2": 'Missing og:description',
    "each_page_should_have": 'Each page should have at least one h1 tag',
    "embed_google_maps_pin": 'Embed Google Maps pin on contact/hero area.',
    "embed_google_maps_pin_and": 'Embed Google Maps pin and ensure NAP (name, address, phone) is visible.',
    "fix_title_include_main": 'Fix title: include main keyword, keep <=60 chars.',
    "add_shorten_h1_and": 'Add/shorten H1 and include main keyword.',
    "fix_meta_description_50": 'Fix meta description: 50-160 chars, include keyword + city.',
    "add_more_copy_500": 'Add more copy (>=500 words). Current: ~{n} words.',
    "add_3_internal_links": 'Add >=3 internal links to relevant pages.',
    "enable_https_redirect_http": 'Enable HTTPS (redirect http -> https).',
    "make_page_mobile_friendly": 'Make page mobile-friendly (viewport, responsive css).',
    "add_descriptive_alt_text": 'Add descriptive ALT text to images.',
    "add_open_graph_meta": 'Add Open Graph meta tags ({names}).',
    "add_clear_q_a": 'Add clear Q&A/FAQ or summary answers near the top.',
    "add_json_ld_with": 'Add JSON-LD with @context and @type.',
    "add_relevant_schema_faqpage": 'Add relevant schema (FAQPage/HowTo/Service/Product/Article).',
    "mention_your_city_region": 'Mention your city/region in Title, H1, and copy.',
    "show_2_3_short": 'Show 2-3 short customer reviews/testimonials with stars.',
    "add_og_title_description": 'Add OG title/description for better previews/snippets.',
    "mention_city_region_in": 'Mention city/region in Title, H1, and copy.',
    "add_hreflang_alternates_for": 'Add hreflang alternates for language/region variants.',
    "use_country_tld_or": 'Use country TLD or clarify location signals.',
    "add_descriptive_alt_text_to": 'Add descriptive ALT text to all images.',
    "set_width_height_for": 'Set width/height for images to reduce layout shift.',
    "use_loading_lazy_for": 'Use loading=lazy for below-the-fold images.',
    "serve_over_https_and": 'Serve over HTTPS and redirect http -> https.',
    "add_canonical_link_to": 'Add canonical link to consolidate duplicates.',
    "fix_broken_internal_links": 'Fix broken internal links.',
    "ensure_important_pages_are": 'Ensure important pages are not blocked or noindex.',
    "add_alt_text_to": 'Add alt text to {n} images',
    "add_descriptive_alt_text_to_images": 'Add descriptive alt text to {n} images',
    "add_descriptive_alt_text_for_ai": 'Add descriptive alt text to {n} images for better AI understanding',
    "implement_hreflang_tags_for": 'Implement hreflang tags for multilingual targeting',
    "add_more_hreflang_tags": 'Add more hreflang tags for complete multilingual coverage',
    "complete_nap_information_add": 'Complete NAP information - add missing phone or address',
    "add_nap_name_address": 'Add NAP (Name, Address, Phone) information for local SEO',
    "add_faq_section_with": 'Add FAQ section with common questions and answers',
    "add_faq_schema_markup": 'Add FAQ schema markup (JSON-LD) for better AI understanding',
    "optimize_meta_description_length": 'Optimize meta description length (150-160 characters) for featured snippets',
    "add_meta_description_optimized": 'Add meta description optimized for featured snippets',
    "consider_question_format_in": 'Consider question format in meta descriptions for better featured snippet chances',
    "include_question_words_how": 'Include question words (how, what, why) in meta descriptions',
    "add_organization_or_website": 'Add Organization or WebSite schema markup',
    "add_json_ld_structured": 'Add JSON-LD structured data for better AI understanding',
    "consider_adding_article_or": 'Consider adding Article or BlogPosting schema for content pages',
    "add_faq_schema_markup_for": 'Add FAQ schema markup for question-answer content',
    "add_clear_h1_heading": 'Add clear H1 heading for better content structure',
    "add_more_h2_headings": 'Add more H2 headings to structure content for AI consumption',
    "use_bullet_points_or": 'Use bullet points or numbered lists for better AI content parsing',
    "include_question_answer_format": 'Include question-answer format in content for better AI understanding',
    "add_localbusiness_or_organization": 'Add LocalBusiness or Organization schema markup',
    "add_geographic_targeting_signals": 'Add geographic targeting signals in content and titles',
    "include_local_business_keywords": 'Include local business keywords in content and titles',
    "ai_instructions_file_2": 'AI Instructions File',
    "llms_txt_file_found": 'llms.txt file found',
    "llms_txt_file_not_found": 'llms.txt file not found',
    "ai_crawler_permissions_2": 'AI Crawler Permissions',
    "robots_txt_allows_ai": 'Robots.txt allows AI crawlers',
    "security_certificate_2": 'Security Certificate',
    "ssl_certificate_active_2": 'SSL certificate active',
    "your_page_is_loading": 'Your page is loading fast',
    "page_loaded_in": 'Page loaded in {ms}ms',
    "mobile_optimization_2": 'Mobile Optimization',
    "site_appears_mobile_friendly": 'Site appears mobile-friendly',
    "structured_data": 'Structured Data',
    "structured_data_found_2": 'Structured data found',
    "priority_improve_2": 'Priority: Improve {signal} (only {share}% coverage)',
    "add_faq_section_with_common": 'Add FAQ section with common customer questions',
    "include_questions_like_what": "Include questions like 'What services do you offer?' and 'How can I contact you?'",
    "add_more_q_a": 'Add more Q&A pairs (aim for 5-10 common questions)',
    "optimize_existing_q_a": 'Optimize existing Q&A for featured snippets (keep answers under 160 characters)',
    "use_specific_descriptive_alt": 'Use specific, descriptive alt text that explains the image content',
    "avoid_generic_alt_text": "Avoid generic alt text like 'image' or 'photo'",
    "include_relevant_keywords_in": 'Include relevant keywords in alt text for better AI understanding',
    "optimize_meta_description_length_150": 'Optimize meta description length (150-160 characters)',
    "consider_question_format_for": 'Consider question format for better featured snippet chances',
    "include_question_words_how_what": 'Include question words (how, what, why) for AI optimization',
    "complete_nap_name_address": 'Complete NAP (Name, Address, Phone) information',
    "include_location_specific_keywords": 'Include location-specific keywords',
    "what_services_do_we": 'What services do we offer? {meta}',
    "descriptive_image_of_the": 'Descriptive image of the page topic.',
    "logo_for": 'Logo for {title}',
    "the_website": 'the website',
    "product_image_for_2": 'Product image for {title}',
    "the_product": 'the product',
    "team_member_photo": 'Team member photo',
    "office_or_building_image": 'Office or building image',
    "image_related_to": 'Image related to {title}',
    "the_content": 'the content',
    "learn_more_about_our": '{meta} Learn more about our services and solutions.',
    "what_is": 'What is {meta}?',
    "brand_is_mentioned_but": "Brand is mentioned but competitors dominate. Create comparison content: 'Why {brand} > {rival}'.",
    "excellent_brand_is_mentioned": 'Excellent! Brand is mentioned without competitors. Maintain this visibility.',
    "brand_is_missing_from": "Brand is missing from AI responses. Create content targeting: '{query}' with clear {brand} positioning.",
    "no_action_needed_brand": 'No action needed - brand is well represented.',
    "brand_missing_from_answer": "Brand missing from answer. Create FAQ schema and blog content targeting: '{query}'.",
    "brand_not_visible_create": "Brand not visible. Create comprehensive content strategy targeting: '{query}' with FAQ schema and blog posts.",
    "maximum_queries_allowed": 'Maximum {limit} queries allowed',
    "some_selected_queries_not": 'Some selected queries not found',
}
