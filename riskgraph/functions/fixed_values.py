"""Fixed values.

Word lists, thresholds, labels and message texts whose exact value decides a
result.  They are data, not logic: every list is written out in its natural
order and used by the expressions of this package.
"""

# --- subjects and records ---------------------------------------------------
SUBJECT_TYPES = ["phone", "bank", "url"]
RISK_SCORES = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.2}
RISK_BOUNDS = [(0.8, "critical"), (0.6, "high"), (0.3, "medium")]
CRAWL_FLOORS = [(10, 0.9), (5, 0.75), (2, 0.55), (1, 0.35)]
CRAWL_FLOOR_DEFAULT = 0.2
QUALITY_GATE = 0.3
REUSE_GATE = 0.5
REPORT_WEIGHT = 0.12
REPORT_WEIGHT_CAP = 0.72
BLACKLIST_SCORE = 0.95
BLACKLIST_LEVEL = "critical"
REPORTS_PER_DAY = 5
DESCRIPTION_MAX_BYTES = 2000

POST_SOURCE = "checkscam_crawl"
BLACKLIST_SOURCE = "tinnhiemmang_crawl"
POST_SITE = "checkscam.vn"
CARD_SITE = "https://admin.vn"
LISTING_URL = "https://tinnhiemmang.vn/filterObj"

# --- urls -------------------------------------------------------------------
TRACKING_KEYS = [
    "fbclid", "gclid", "dclid", "gbraid", "wbraid", "ved", "ei", "sei", "sa", "usg",
    "aqs", "oq", "source", "sxsrf", "sca_esv", "rlz", "iflsig", "sclient", "qh_ss", "srsltid",
]
DOCUMENT_SUFFIXES = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip"]
ARTICLE_MARKERS = [
    "/posts/", "/post/", "/threads/", "/thread/", "/groups/",
    "/warning/", "/report/", "/article/", "/articles/", "/news/",
]
KNOWN_SOURCE_DOMAINS = [
    "checkscam.vn", "tinnhiemmang.vn", "chongluadao.vn", "feeds.chongluadao.vn", "trangtrang.com",
]
SOCIAL_DOMAINS = ["facebook.com", "fb.watch"]
STATIC_SLUGS = [
    "thong-tin", "lien-he", "marketing", "gioi-thieu", "bio", "to-cao-lua-dao",
    "chinh-sach-bao-mat", "dieu-khoan-su-dung", "huong-dan", "lien-ket", "tin-tuc", "hoi-dap",
]
EXCLUDED_DETAIL_PATHS = ["/bio/", "/newfeed/", "/dich-vu-uy-tin/"]
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "gif"]
IMAGE_TYPES = {
    "image/jpeg": "jpg", "image/png": "png", "image/webp": "webp",
    "image/gif": "gif", "image/svg+xml": "svg",
}

# --- text screens -----------------------------------------------------------
SCAM_KEYWORDS = [
    "lừa đảo", "lua dao", "scam", "tố cáo", "to cao", "cảnh báo", "canh bao", "giả mạo",
    "gia mao", "bùng", "quỵt", "chiếm đoạt", "chiem doat", "chuyển tiền", "không trả",
    "mat tien", "mất tiền",
]
GENERIC_KEYWORDS = [
    "hướng dẫn", "huong dan", "cách", "cach", "kinh nghiệm", "kinh nghiem", "mẹo", "meo",
    "nhận biết", "nhan biet", "phòng tránh", "phong tranh", "tra cứu", "tra cuu", "là gì",
    "la gi", "quy trình", "quy trinh", "tổng hợp", "tong hop",
]
SCHEMA_FIELD_MARKERS = ["summary:", "key_facts", "phone_mentions", "risk_signals", "evidence_urls"]
TECHNICAL_MARKERS = [
    "page expired", "unauthorized", "invalid api key", "authentication_error",
    "llm upstream error", "server error", "moved permanently", "http status", "status code",
    "redirect", "parser", "parse json", "raw html", "timeout", "timed out", "proxy",
    "transport error", "cache hit", "sidecar", "scraper", "json error", "http client",
    "cloudflare", "nginx", "javascript", "cookies", "dns-prefetch", "<link", "<script",
    "<meta", "<div", "<html", "nội dung scrape", "challenge", "captcha", "403 forbidden",
    "404 not found", "500 internal", "502 bad gateway", "503 service", "connection refused",
    "connection reset", "ssl", "tls", "certificate", "enablejs", "recaptcha",
    "verify you are human", "access denied", "bot detection", "rate limit",
]
EMBEDDED_NOISE_MARKERS = [
    "if(window.location.hostname", '{"@context"', '{ "@context"', "<script",
    ".wp-block-button__link", "body{--wp--preset", "window._nslDOMReady",
    "/*! This file is auto-generated */",
]
CDN_VENDOR_MARKERS = ["cloudflare", "cf-error", "cf-challenge"]
CDN_BLOCK_PHRASES = [
    "you have been blocked", "attention required", "just a moment", "enable cookies",
    "cf-challenge", "challenge-platform", "ray id", "cf-turnstile",
]
CAPTCHA_MARKERS = [
    "detected unusual traffic", "our systems have detected unusual traffic", "g-recaptcha",
    "/sorry/index", 'id="captcha"', 'name="captcha"', "captcha-form",
]
CONSENT_MARKERS = ["consent.google"]
ENABLEJS_MARKERS = ["/httpservice/retry/enablejs"]
ANOMALY_MARKERS = ["anomaly-modal", "anomaly.js", "bots use duckduckgo too"]
CARRIERS = ["Viettel", "Mobifone", "MobiFone", "Vinaphone", "Vietnamobile", "Gmobile", "Reddi"]
ORG_PREFIX = "Mạo danh tổ chức:"
ORG_UNKNOWN = "Chưa xác định"
DETECTED_PREFIX = "Đã phát hiện ngày "
HTML_NAMED_ENTITIES = [
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    ("&quot;", '"'), ("&#039;", "'"), ("&apos;", "'"),
]

# --- incident posts ---------------------------------------------------------
OWNER_LINE = "Chủ tài khoản: "
PHONE_LINE = "Số điện thoại: "
ACCOUNT_LINE = "Số tài khoản: "
BANK_LINE = "Ngân hàng: "
WARNING_LINE = "Nội dung cảnh báo: "
COUNT_LINE = "Số lần bị cảnh báo trên CheckScam: "
HISTORY_LINE = "Lịch sử phản ánh cùng STK: "
MORE_LABEL = "Xem thêm"
GENERIC_HEADING = "Thông tin cảnh báo:"
BODY_END = "#s1"
QUICK_SUMMARY_START = "Họ Tên:"
QUICK_SUMMARY = (
    r"Họ Tên:\s*(.*?)\s*,\s*SĐT:\s*(.*?)\s*,\s*STK:\s*([0-9*]+)\s*,"
    r"\s*Ngân hàng:\s*(.*?)\s*,\s*(.*?)(?:#s1|KIỂM TRA & TỐ CÁO SCAM)"
)
OWNER_PATTERN = r"Chủ tk:\s*(.*?)\s*STK:"
PHONE_PATTERN = r"SĐT:\s*([0-9 .-]{9,16})"
ACCOUNT_PATTERN = r"STK:\s*([0-9*]{6,})"
BANK_PATTERN = r"Ngân hàng:\s*(.*?)\s*(?:Hạng mục:|Ảnh chụp bằng chứng:|Nội dung cảnh báo:)"
WARNING_PATTERN = (
    r"Nội dung cảnh báo:\s*(.*?)\s*(?:💬|_{3,}|Bình luận Copy link|LỊCH SỬ PHẢN ÁNH)"
)
COUNT_PATTERN = r"đã bị cảnh báo\s+(\d+)\s+lần"
SITE_COUNT_PATTERN = r"Có\s+(\d+)\s+cảnh báo"
TITLE_LABELLED_PHONE = r"(?iu)(?:sđt|sdt|điện thoại|số điện thoại)\s*:\s*([0-9 .-]{9,16})"
TITLE_PHONE = r"\b0\d{8,10}\b"
TITLE_ACCOUNT = r"\b[0-9]{6,20}\b"
ACCOUNT_WORDS = ["stk", "tài khoản"]
PHONE_WORDS = ["sđt", "sdt", "điện thoại", "số điện thoại"]

# --- sources ----------------------------------------------------------------
SOURCE_LABELS = {
    "AdminVN": "Admin.vn", "CheckScam": "CheckScam.vn", "ChongLuaDao": "ChongLuaDao.vn",
    "TrangTrang": "TrangTrang", "TinNhiemMang": "TinNhiemMang.vn",
    "Google": "Google", "DuckDuckGo": "DuckDuckGo",
}
SOURCES_FOR_ALL = ["AdminVN", "CheckScam", "TinNhiemMang"]
SOURCES_FOR_PHONE = ["ChongLuaDao", "TrangTrang"]
DEDICATED_SOURCES = ["AdminVN", "CheckScam", "ChongLuaDao"]
ENGINES = ["Google", "DuckDuckGo"]
CANDIDATE_LIMIT = 30
TARGET_LIMIT = 10

# --- labels and report texts ------------------------------------------------
RISK_LABELS = {"critical": "rất cao", "high": "cao", "medium": "trung bình", "low": "thấp"}
RISK_LABEL_UNKNOWN = "chưa rõ"
QUERY_LABELS = {
    "phone": "Số điện thoại đang tra cứu",
    "bank": "Tài khoản đang tra cứu",
    "url": "Địa chỉ đang tra cứu",
}
CONFIDENCE_TEXTS = [
    (0.85, "Hệ thống khá chắc chắn về nhận định này: %s."),
    (0.65, "Hệ thống có độ chắc chắn tương đối tốt về nhận định này: %s."),
    (0.45, "Nhận định này ở mức tham khảo, độ chắc chắn khoảng %s."),
]
CONFIDENCE_TEXT_LOW = "Dữ liệu còn hạn chế, độ chắc chắn hiện khoảng %s."
NOTHING = "không có"
NO_RELEVANT_INFO = "Không có thông tin liên quan"
BASELINE_REPORT = "Nguồn %s ghi nhận %d mục liên quan. Nội dung nổi bật từ bài report đầu tiên: %s"
BASELINE_RESULT = "Nguồn %s ghi nhận %d kết quả liên quan. Manh mối nổi bật: %s %s"
BASELINE_EMPTY = "Nguồn %s không trả về dữ liệu chi tiết để tóm tắt thêm."
BASELINE_SIGNAL = "Nguồn %s có %d mục liên quan cần điều tra sâu hơn."
FALLBACK_SIGNAL = "Nguồn %s có dữ liệu liên quan và nên được kiểm tra thêm."
FALLBACK_EMPTY = "Nguồn %s có phản hồi nhưng chưa đủ dữ liệu rõ ràng để kết luận thêm."
FALLBACK_SUMMARY = (
    "Nguồn %s có dữ liệu liên quan, nhưng nội dung chưa đủ rõ để tóm tắt trọn vẹn. "
    "Manh mối chính ghi nhận được: %s"
)
FALLBACK_REPORT = (
    "## Báo cáo tạm thời\n\n"
    "Hệ thống AI đang gặp sự cố nên tôi đang tự tổng hợp báo cáo tạm thời từ những dấu vết "
    "đã thu thập được.\n\n"
    "### Thông tin đã ghi nhận\n\n"
    "- %s: `%s`\n"
    "- Đã nhận phản hồi từ: %d/%d nguồn\n\n"
    "### Dấu hiệu nổi bật\n\n"
    "- Tín hiệu rủi ro từ các nguồn đã rà soát: %s\n"
    "- Tín hiệu rủi ro từ các trang được xem kỹ hơn: %s\n"
    "- Chi tiết nổi bật đã ghi nhận: %s\n"
    "- Thực thể liên quan đã bóc tách: %s\n\n"
    "### Kết luận tạm thời\n\n"
    "Mức rủi ro hiện được đánh giá là %s. Nếu bạn đang cân nhắc giao dịch hoặc chia sẻ thông "
    "tin nhạy cảm, nên dừng lại và kiểm tra thêm trước khi tiếp tục.\n\n"
    "RISK_LEVEL: %s\n"
    "CONFIDENCE: %s"
)
PHASE_LABELS = {
    1: "Cache hit", 2: "Tóm tắt nguồn", 3: "Chọn URL điều tra sâu",
    4: "Phân tích URL", 5: "Tổng hợp điều tra",
}
STATUS_FAILED_TEXT = "Không lấy được dữ liệu từ %s."
STATUS_FOUND_TEXT = "Tìm thấy %d kết quả liên quan."
STATUS_NOTHING_TEXT = "Đã kiểm tra nhưng chưa thấy kết quả cụ thể."
QUERY_SUFFIXES = {
    "phone": ['%s', '"%s"', '%s lừa đảo', '"%s" lừa đảo'],
    "bank": ['%s', '"%s"', '"%s" tài khoản ngân hàng lừa đảo'],
    "url": ['%s', '"%s"', '"%s" cảnh báo lừa đảo'],
}
