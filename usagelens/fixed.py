"""Lists, limits, prices, patterns and labels that results depend on.

Patterns are written so that the JVM regex engine and RE2 read them alike.
"""

from __future__ import annotations

from decimal import Decimal

# --------------------------------------------------------------------------- time
HOUR_MS = 3_600_000
DAY_MS = 86_400_000
MINUTE_MS = 60_000
EARLIEST_MS = 1_672_531_200_000  # 2023-01-01 UTC: older stamps are treated as unreadable

# ------------------------------------------------------------------------ devices
DEVICES = ["local", "vps", "windows", "unknown"]
REMOTE_FOLDERS = [("windows-usage", "windows"), ("vps", "vps")]

# ------------------------------------------------------------------------ sources
# tool, label, kind, normaliser version, billed to the user's own API wallet, subscription
SOURCES = [
    ("claude-code", "Claude Code", "jsonl", 4, False, True),
    ("ccmr", "ccmr", "jsonl", 4, True, False),
    ("codex", "Codex", "jsonl", 6, False, True),
    ("zcode", "ZCode", "table", 2, False, True),
    ("dsh", "dsh", "zst", 4, True, False),
    ("grok", "Grok Build", "jsonl", 1, False, True),
    ("workbuddy", "WorkBuddy", "jsonl", 1, False, True),
    ("pi", "Pi", "jsonl", 1, False, False),
    ("opencode", "OpenCode", "table", 2, False, False),
    ("antigravity", "Antigravity", "jsonl", 3, False, True),
    ("kimi", "Kimi Code", "jsonl", 1, False, True),
    ("qoder", "Qoder", "jsonl", 1, False, True),
    ("doubao", "豆包", "decoded", 2, False, True),
    ("doubaowork", "豆包工作", "decoded", 2, False, True),
    ("cursor", "Cursor", "csv", 1, False, True),
    ("hermes", "Hermes", "table", 1, False, False),
]
SQL_KINDS = ["table"]

# ------------------------------------------------------------------- model naming
WHITESPACE = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
VENDOR_PREFIX = r"^cursor-(.+)$"
EFFORT_SUFFIXES = r"^(.+?)(?:-(?:low|medium|high))+$"
MODEL_ALIASES = {
    "deepseek-flash": "deepseek-v4.1-flash",
    "deepseek-v4-flash": "deepseek-v4.1-flash",
}
# (tool, model) -> priced model
PRICING_ALIASES = [
    ("antigravity", "gemini-3.8-flash-n", "gemini-3.8-flash"),
    ("kimi", "k3", "kimi-k3"),
    ("workbuddy", "kimi-k3-1", "kimi-k3"),
    ("workbuddy", "hy4-preview-f", "hy4-preview"),
    ("grok", "grok-4.6-build", "grok-4.6"),
    ("grok", "grok-4.7-build", "grok-4.7"),
]
DISPLAY_FAMILIES = ["gemini", "claude", "gpt"]
DISPLAY_EFFORT_WORDS = r"(?i)\b(thinking|xhigh|high|medium|low|fast)\b"
MODEL_SELECTION = (
    r"(?i)changed setting `Model Selection` from .*? to ([^`\n]+?)(?:\s*\([^)]*\))?\.(?:\s+|$)"
)
MERGED_CHART_FAMILY = ("deepseek", "deepseek-v4.1-flash")
BYOK_PREFIX = (
    r"(?i)^qoder-custom-[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}/"
)

# --------------------------------------------------------------- token estimation
CJK_CLASS = (
    r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
    r"\x{f900}-\x{faff}\x{ac00}-\x{d7af}\x{20000}-\x{2ffff}]"
)

# ---------------------------------------------------------------- names and labels
INVISIBLE_CLASS = (
    r"[\x{00}-\x{1f}\x{7f}-\x{9f}\x{200b}-\x{200f}\x{2028}-\x{202e}"
    r"\x{2060}-\x{2064}\x{2066}-\x{2069}\x{feff}]"
)
LINK_PATTERN = (
    r"(?i)(https?://|www\.)|(\.(com|cn|net|org|io|dev|app|xyz|me|cc)([^A-Za-z0-9_]|$))"
)
LABEL_PATTERN = r"(?i)^[a-z0-9][a-z0-9._:/+-]*$"
BLOCKED_WORDS = [
    "fuck", "shit", "bitch", "asshole", "cunt", "dick", "nigg", "spam",
    "admin", "官方", "管理员", "运营",
]
NAME_MAX = 16
ANONYMOUS_PREFIX = "匿名-"
CATEGORY_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._:/-]{0,159}$"
KEY_LIKE_PATTERN = r"(?i)^(?:sk[-_]|ghp_|github_pat_|AKIA)"
UNREGULATED_CATEGORY = "未规范标识"
UNKNOWN_TOOL = "未标注工具"
UNKNOWN_MODEL = "未标注模型"
MASKED_MODEL_PATTERN = r"(?i)^[a-z0-9][a-z0-9._:/-]{0,159}$"
MASKED_KEY_LIKE = r"(?i)^(sk-|ghp_|github_pat_|AKIA)"
MASKED_CWD = "/windows-office"
UUID4_PATTERN = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
)
SESSION_ID_PATTERN = r"^[^\x{00}-\x{1f}\x{7f}]{1,256}$"

# -------------------------------------------------------------------- file names
SYNC_CONFLICT_PATTERN = r"(\.sync-conflict-[^/\\]*$)|( \([0-9]+\)\.[^./\\]+$)"
LOG_SUFFIX = r"(?i)\.jsonl(?:\.(?:zst|zstd))?$"
COWORK_FOLDER = "local-agent-mode-sessions"

# -------------------------------------------------------------------- integrity
MAX_SAFE_INTEGER = 9_007_199_254_740_991

# ---------------------------------------------------------------------- latency
MAX_DURATION_MS = 900_000
MIN_DURATION_MS = 1
MIN_OUTPUT_FOR_SPEED = 20
APPROXIMATE_TOOLS = ["codex"]
REPLAY_GAP_MS = 500
MAX_PENDING_REQUESTS = 200
TRIGGER_PATTERN = (
    r'"type":"(?:task_started|user_message|function_call_output|custom_tool_call_output)"'
)

# ------------------------------------------------------------------------ prices
DEFAULT_FX = Decimal("7.2")
FX_RANGE = (5.5, 9.5)
LONG_CONTEXT_TOKENS = 200_000
LONG_CONTEXT_EXEMPT_TOOLS = ["cursor", "grok"]
# UTC weekdays, hours in these inclusive spans
PEAK_HOURS = [(1, 3), (6, 9)]

# Default user price book, per million tokens:
# model, currency, input, cached input, output, cache write, off-peak factor
SEED_PRICES = [
    ("deepseek-v4.1-flash", "USD", "0.30", "0.006", "1.20", None, "0.5"),
    ("deepseek-v4-flash", "USD", "0.30", "0.006", "1.20", None, "0.5"),
    ("deepseek-v4-pro", "USD", "1.32", "0.044", "3.96", None, "0.5"),
    ("kimi-k2.6", "CNY", "6.50", "1.10", "27.0", None, None),
    ("kimi-k2.7-code", "CNY", "6.50", "1.30", "27.0", None, None),
    ("kimi-k3", "CNY", "20.0", "2.00", "100.0", None, None),
]

# Instants at which a listed price changes (UTC epoch ms)
_DEC_2026 = 1_796_083_200_000
_JAN_2027 = 1_798_761_600_000
_OCT_13_2026_1630 = 1_791_909_000_000

# Official list prices, per million tokens:
# model, tool (None = any), long context (None = any), valid from, valid to,
# currency, input, cached input, output, cache write
OFFICIAL_PRICES = [
    ("gemini-4-argon", None, None, None, _DEC_2026, "USD", "2", "0.10", "10", "0"),
    ("gemini-4-argon", None, None, _DEC_2026, None, "USD", "4", "0.20", "20", "0"),
    ("gemini-3.8-flash", None, None, None, _JAN_2027, "USD", "0.75", "0.075", "3.75", "0"),
    ("gemini-3.8-flash", None, None, _JAN_2027, None, "USD", "1.50", "0.15", "7.50", "0"),
    ("claude-opus-5-5", None, None, None, None, "USD", "4", "0.20", "20", "5"),
    ("claude-opus-5-5-max", "cursor", None, None, None, "USD", "4.8", "0.24", "24", "6"),
    ("grok-4.7", None, False, None, None, "USD", "2", "0.5", "6", "0"),
    ("grok-4.7", None, True, None, None, "USD", "4", "1", "12", "0"),
    ("grok-4.6", None, False, None, None, "USD", "2", "0.5", "6", "0"),
    ("grok-4.6", None, True, None, None, "USD", "4", "1", "12", "0"),
    ("grok-4.5", None, False, None, None, "USD", "2", "0.3", "6", "0"),
    ("grok-4.5", None, True, None, None, "USD", "4", "0.6", "12", "0"),
    ("grok-4.7-high-fast", "cursor", False, None, None, "USD", "4", "1", "12", "0"),
    ("grok-4.7-high-fast", "cursor", True, None, None, "USD", "6", "1.5", "18", "0"),
    ("grok-4.7-high-fast", "grok", False, None, None, "USD", "4", "1", "12", "0"),
    ("grok-4.7-high-fast", "grok", True, None, None, "USD", "6", "1.5", "18", "0"),
    ("grok-4.7-fast", "cursor", False, None, None, "USD", "4", "1", "12", "0"),
    ("grok-4.7-fast", "cursor", True, None, None, "USD", "6", "1.5", "18", "0"),
    ("grok-4.7-fast", "grok", False, None, None, "USD", "4", "1", "12", "0"),
    ("grok-4.7-fast", "grok", True, None, None, "USD", "6", "1.5", "18", "0"),
    ("kimi-k3", None, None, None, None, "CNY", "20", "2", "100", "20"),
    ("qwen4-max", None, None, None, None, "CNY", "10", "0.5", "30", "12.5"),
    ("hy4-preview", None, None, None, None, "CNY", "6", "0.3", "18", "0"),
    ("step-5-preview", None, None, None, _OCT_13_2026_1630, "CNY", "7", "0.35", "20", "0"),
    ("step-5-preview", None, None, _OCT_13_2026_1630, None, "CNY", "7", "0.70", "20", "0"),
    ("mimo-v2.5-free", "opencode", None, None, None, "USD", "0", "0", "0", "0"),
    ("stealth/union-alpha", "opencode", None, None, None, "USD", "0", "0", "0", "0"),
    ("deepseek/deepseek-v4-flash-0731", None, None, None, None, "USD", "0.016", "0.016", "0.64", "0"),
]
CATALOG_ALIASES = {"grok-4.6-build": "grok-4.6"}
CATALOG_AGGREGATORS = r"^(openrouter|cloudflare|bedrock_mantle|us-gov)"
CATALOG_CLOUDS = r"^(azure|vertex_ai|azure_ai|bedrock)"

# ------------------------------------------------------------------- reconciliation
PROVIDER_PREFIXES = {"deepseek": "deepseek", "kimi": "kimi", "glm": "glm"}

# ---------------------------------------------------------------------- leaderboard
DAY_TOKENS_LIMIT = 20_000_000_000
HOUR_TOKENS_LIMIT = 5_000_000_000
DAY_REQUESTS_LIMIT = 200_000
TOKENS_PER_REQUEST_LIMIT = 5_000_000
REPORT_MAX_BYTES = 16 * 1024
THROTTLE_MS = 60_000
FRESH_MS = 24 * HOUR_MS
RETAIN_MS = 30 * DAY_MS
BOARD_ROWS = 50
CLAMP_LIMITS = {
    "day_tokens": 1_000_000_000_000,
    "day_requests": 10_000_000,
    "week_tokens": 10_000_000_000_000,
    "month_tokens": 50_000_000_000_000,
    "roi_ratio": 10_000,
}
REASON_NUMBERS = "usage must be non-negative numbers"
REASON_DAY = "day_tokens implausible"
REASON_GROWTH = "day_tokens grew too fast"
REASON_REQUESTS = "day_requests implausible"
REASON_NO_REQUESTS = "usage without requests"
REASON_PER_REQUEST = "tokens per request implausible"
REASON_WINDOWS = "windows inconsistent"
REASON_TOTALS = "window totals implausible"

# --------------------------------------------------------------------------- alerts
ALERT_METRICS = ["codex_quota_pct", "balance", "today_tokens", "claude_5h_tokens"]
# id, metric, enabled, warn, crit
DEFAULT_ALERT_RULES = [
    ("codex_quota_pct", "codex_quota_pct", True, 80.0, 95.0),
    ("balance", "balance", True, 10.0, 2.0),
    ("today_tokens", "today_tokens", False, None, None),
    ("claude_5h_tokens", "claude_5h_tokens", False, None, None),
]

# ---------------------------------------------------------------------------- quota
MAIN_LIMIT_ID = "codex"
QUOTA_STALE_MS = 30 * MINUTE_MS
MCP_MAX_AGE_MS = 6 * HOUR_MS
MCP_MARKER = "官方 MCP 额度响应"
PLAN_WINDOW_LABELS = {"CREDIT_LIMIT:3": "5 小时", "CREDIT_LIMIT:6": "每周"}
LIVE_TTL_MS = 10 * MINUTE_MS

# ---------------------------------------------------------------------------- charts
HEAT_STEPS = [0.15, 0.35, 0.6, 0.85]
