"""Fixed values.

Everything in this module is a literal that must equal the behaviour being
reproduced (word lists, patterns, limits, scores). They are stated plainly, in
their natural order, and are not derived from anything else.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — seed dictionary (7 categories, insertion order matters for
# the arg-max tie-break).
# ---------------------------------------------------------------------------
SEED_CATEGORIES = [
    {
        "id": "study",
        "name_zh": "学习",
        "name_en": "Study",
        "keywords_zh": ["学习", "教程", "课程", "笔记", "论文", "教材", "考试", "复习", "习题", "答案",
                        "作业", "练习", "知识点", "课件", "讲义", "学术", "研究", "博士", "硕士", "本科"],
        "keywords_en": ["tutorial", "course", "lecture", "study", "learn", "textbook", "paper", "arxiv",
                        "homework", "exam", "thesis", "dissertation", "syllabus"],
        "extensions": [".pdf", ".epub", ".mobi"],
    },
    {
        "id": "memo",
        "name_zh": "备忘",
        "name_en": "Memo",
        "keywords_zh": ["备忘", "便签", "灵感", "摘录", "引用", "代码片段", "记住", "参考", "速查"],
        "keywords_en": ["snippet", "memo", "note", "cheatsheet", "checklist", "quickref", "reference"],
        "extensions": [],
    },
    {
        "id": "reminder",
        "name_zh": "提醒",
        "name_en": "Reminder",
        "keywords_zh": ["截止", "提醒", "预约", "会议", "日程", "行程", "到期", "过期", "邀请函"],
        "keywords_en": ["deadline", "due", "appointment", "calendar", "meeting", "schedule", "reminder"],
        "extensions": [],
    },
    {
        "id": "life",
        "name_zh": "生活",
        "name_en": "Life",
        "keywords_zh": ["菜谱", "食谱", "健康", "旅行", "购物", "穿搭", "家居", "运动", "锻炼", "健身",
                        "宠物", "美食", "餐厅", "旅游", "摄影", "手工"],
        "keywords_en": ["recipe", "health", "travel", "shopping", "fashion", "home", "gym", "pet", "food",
                        "restaurant", "photo", "diy", "cooking"],
        "extensions": [],
    },
    {
        "id": "task",
        "name_zh": "任务",
        "name_en": "Task",
        "keywords_zh": ["项目", "需求", "进度", "报告", "周报", "月报", "计划", "任务", "开发", "部署",
                        "上线", "测试", "发布", "迭代"],
        "keywords_en": ["project", "requirement", "progress", "report", "plan", "task", "todo",
                        "prd", "spec", "roadmap", "milestone", "sprint", "deploy", "release"],
        "extensions": [],
    },
    {
        "id": "finance",
        "name_zh": "财务",
        "name_en": "Finance",
        "keywords_zh": ["发票", "账单", "收据", "合同", "报税", "工资", "银行", "流水", "报销", "预算",
                        "贷款", "保险", "理财", "投资", "税务"],
        "keywords_en": ["invoice", "bill", "receipt", "contract", "tax", "salary", "bank", "transaction",
                        "expense", "budget", "loan", "insurance", "investment"],
        "extensions": [".xlsx", ".xls", ".csv"],
    },
    {
        "id": "work",
        "name_zh": "职务",
        "name_en": "Work",
        "keywords_zh": ["述职", "绩效", "考核", "晋升", "简历", "面试", "入职", "工作", "汇报", "纪要",
                        "周报", "日报", "总结", "规划"],
        "keywords_en": ["performance", "review", "promotion", "resume", "cv", "interview", "onboarding",
                        "work", "presentation", "minutes", "report"],
        "extensions": [],
    },
]

# FIXED VALUES — display-name translation used when a category is added with locale zh.
NAME_TRANSLATION = {
    "学习": "Study", "备忘": "Memo", "提醒": "Reminder", "生活": "Life",
    "任务": "Task", "财务": "Finance", "职务": "Work",
}

# FIXED VALUES — special category values that are not rows of `categories`.
INBOX = "_inbox"
ARCHIVE = "_archive"
SENSITIVE = "_sensitive"
CATEGORY_DIRS = ["学习", "备忘", "提醒", "生活", "任务", "财务", "职务"]
OVERDUE_CATEGORY = "提醒"

# FIXED VALUES — classification scores.
EXT_BONUS = 2.0
TIER_FILENAME = 3
TIER_KEYWORD = 2
TIER_TEXT = 1
LOCALE_BONUS = 1.2
CEILING_PER_KEYWORD = 2.5
CEILING_MIN = 5.0
LOW_CONFIDENCE = 0.3
MAX_SUGGESTIONS_FROM_TOP = 3
MAX_REASONS = 5
REASON_NO_MATCH = "No keyword matches — needs manual classification"
REASON_NO_CATEGORIES = "No categories defined"

# FIXED VALUES — learning rule.
SEED_WEIGHT = 1.0
USER_WEIGHT = 1.5
UP_FACTOR = 1.3
UP_ADD = 0.2
UP_CAP = 3.0
DOWN_FACTOR = 0.7
DOWN_FLOOR = 0.1
NEW_DOWN_WEIGHT = 0.3
NEW_UP_WEIGHT = 1.5

# FIXED VALUES — limits.
SEARCH_LIMIT = 50
DESCRIPTION_LIMIT = 50
TOP_VIEWED = 10
TOP_CORRECTED = 10
RECOMMEND_LIMIT = 5
ARCHIVE_DAYS = 180
KEYWORDS_TOP_K = 20
TEXT_CAP = 50000
SCANNED_MIN_CHARS = 50
SENSITIVE_TEXT_CAP = 500
SENSITIVE_REPORT_CAP = 200
UNGROUPED_LIST_CAP = 20
MAX_FILE_BYTES = 500 * 1024 * 1024
CATEGORY_NAME_CAP = 64
SLUG_CAP = 32
FOLDER_NAME_CAP = 50

# FIXED VALUES — what Python's str.split() treats as whitespace (as a regex class
# both Java regex and RE2 accept).
WHITESPACE_RUN = (r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                  r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")

# FIXED VALUES — keyword extraction: characters stripped from both ends of a word.
KEYWORD_STRIP_CHARS = ".,!?;:()[]{}<>\"'，。！？；：（）【】《》"

# FIXED VALUES — category suggestion.
SUGGEST_MIN_FILES = 5
SUGGEST_MOST_COMMON = 30
SUGGEST_MIN_COUNT = 3
SUGGEST_MIN_LEN = 2
SUGGEST_PAIR_MIN = 2
SUGGEST_CLUSTER_MIN = 3
SUGGEST_TOP = 3
SUGGEST_KEYWORDS = 10
SUGGEST_SAMPLES = 3
STOP_WORDS = ["the", "a", "an", "is", "of", "to", "in", "and", "的", "了", "是", "在", "和",
              "2024", "2025", "2026"]

# FIXED VALUES — extraction suffix sets.
TEXT_EXTENSIONS = [".txt", ".md", ".csv", ".json", ".yaml", ".yml", ".xml", ".html", ".log", ".py",
                   ".js", ".ts", ".sh", ".bash", ".css", ".toml", ".ini", ".cfg"]
IPYNB_EXTENSIONS = [".ipynb"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif", ".tiff"]
PDF_EXTENSIONS = [".pdf"]
DOCX_EXTENSIONS = [".docx", ".doc"]
PPTX_EXTENSIONS = [".pptx", ".ppt"]
AUDIO_EXTENSIONS = [".mp3", ".wav", ".ogg", ".flac", ".m4a"]
VIDEO_EXTENSIONS = [".mp4", ".mov", ".avi", ".mkv", ".webm"]

# FIXED VALUES — catalogue listing type flags (narrower than the extraction sets).
FLAG_IMAGE = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp"]
FLAG_VIDEO = [".mp4", ".webm", ".mov", ".avi"]
FLAG_AUDIO = [".mp3", ".wav", ".ogg", ".flac"]
FLAG_TEXT = [".txt", ".md", ".csv", ".json", ".log", ".py"]
FLAG_PDF = [".pdf"]

# FIXED VALUES — extensions that may be served, and their MIME types.
ALLOWED_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp",
    ".mp4", ".webm", ".mov", ".avi",
    ".mp3", ".wav", ".ogg", ".flac",
    ".pdf",
    ".txt", ".md", ".csv", ".json", ".log", ".py", ".js", ".html", ".css",
    ".docx", ".pptx", ".xlsx",
    ".ipynb",
]
MIME_MAP = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
    ".png": "image/png", ".gif": "image/gif",
    ".webp": "image/webp", ".bmp": "image/bmp",
    ".mp4": "video/mp4", ".webm": "video/webm",
    ".mov": "video/quicktime", ".avi": "video/x-msvideo",
    ".mp3": "audio/mpeg", ".wav": "audio/wav",
    ".ogg": "audio/ogg", ".flac": "audio/flac",
    ".pdf": "application/pdf",
    ".txt": "text/plain; charset=utf-8",
    ".md": "text/markdown; charset=utf-8",
    ".json": "application/json",
    ".csv": "text/csv; charset=utf-8",
    ".ipynb": "application/json",
}
DEFAULT_MIME = "application/octet-stream"

# FIXED VALUES — attempt throttle.
MAX_ATTEMPTS = 5
ATTEMPT_WINDOW_SECONDS = 60

# FIXED VALUES — file grouping.
MIN_GROUP_SIZE = 2
STEM_SUFFIX_PATTERNS = [r"[ _\-]v\d+$", r"[ _\-]ver\w*$", r"[ _\-]final$",
                        r"[ _\-]draft$", r"[ _\-]副本$", r"[ _\-]copy$",
                        r"[ _\-]old$", r"[ _\-]new$", r"[ _\-]edited$",
                        r"[ _\-]\d+\.\d+$", r"\(\d+\)$", r"（\d+）$"]
STEM_TRAILING_DIGITS = r"[ _\-]?\d{2,}$"
STEM_DATE_PREFIX = r"^\d{4}[ _\-]?\d{2}[ _\-]?\d{2}[ _\-]"
STEM_SEPARATORS = ["_", "-", " "]
STEM_CHAPTER = r"[第]?\d+[章节部分]?"
VERSION_WORDS = ["v1", "v2", "v3", "final", "draft", "old", "new", "副本"]
DEFAULT_FOLDER_NAME = "Grouped Files"
DEFAULT_SAFE_FOLDER = "GroupedFiles"

# ---------------------------------------------------------------------------
# FIXED VALUES — personal-data patterns, in priority order (type, pattern).
# ---------------------------------------------------------------------------
PII_PATTERNS = [
    ("身份证号", r"\b(\d{6})(\d{4})(\d{2})(\d{2})(\d{3})[\dXx]\b"),
    ("手机号", r"\b1[3-9]\d[-\s]?\d{4}[-\s]?\d{4}\b"),
    ("邮箱", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("证件号", r"\b[CEGKMSTWcegkmstw]\d{7,8}\b"),
    ("通行证号", r"\bCD\d{7}\b"),
    ("学号", r"\b(?:DC|MC|dc|mc)\d{5,8}\b"),
    ("学号2", r"\bD-C\d-\d{4}-\d\b"),
    ("地址",
     r"((?:河南|河北|北京|上海|广东|深圳|浙江|江苏|山东|四川|湖北|湖南|福建"
     r"|安徽|江西|辽宁|吉林|黑龙江|陕西|山西|甘肃|云南|贵州|海南|台湾"
     r"|内蒙古|广西|西藏|宁夏|新疆|重庆|天津)(?:省|市|自治区|特别行政区)?"
     r"(?:[\u4e00-\u9fff]{1,10}(?:市|区|县|镇|乡|村))?"
     r"(?:[\u4e00-\u9fff]{1,20}(?:路|街|道|巷|弄|号|楼|层|室|单元|院|园|大厦|公寓|小区))"
     r"(?:\d{1,6}[号栋幢座]?\d{0,4}[室号]?)"
     r"(?:[\d一二三四五六七八九十]{1,2}[层楼])?)"),
    ("澳大学号", r"(?i)\bmc\d{6}\b"),
    ("姓名", r"(?:姓名|Name)[：:]\s*([\u4e00-\u9fff]{2,4})"),
]
PII_STUDENT_TYPES = ["学号", "学号2", "澳大学号"]
PII_PERMIT_TYPES = ["证件号", "通行证号"]
PII_SHORT_MASK_TYPES = ["证件号", "通行证号", "学号", "学号2", "澳大学号"]
PII_OTHER_MASK = "[已脱敏]"
PII_ADDRESS_SHORT_MASK = "***地址***"
PII_NAME_EMPTY_MASK = "姓名: ***"
PII_TYPE_SEPARATOR = "、"
PII_DESC_STUDENT = "学生证件"
PII_DESC_PERSONAL = "个人证件"
PII_DESC_PERMIT = "通行证件"
# context label, then the substrings that trigger it (case-sensitive)
PII_CONTEXT_TESTS = [
    ("澳大", ["澳门", "Macau", "澳門"]),
    ("保密", ["保密", "confidential"]),
    ("学生", ["学生", "student", "Student"]),
    ("协议", ["协议", "agreement"]),
    ("声明", ["声明", "declaration"]),
]
PII_FILENAME_HINT_WORDS = ["保密", "协议", "声明", "澳大", "身份证", "通行证", "学生证",
                           "合同", "NDA", "confidential", "agreement", "passport",
                           "澳门", "大学", "研究生", "本科"]
PII_UNKNOWN_SENSITIVE = "敏感文件（未识别到具体类型）"
