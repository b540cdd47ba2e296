"""Fixed values that results depend on.

FIXED VALUES — these must equal the values the original toolkit uses, so they
are kept verbatim and in their original order.
"""

# ---- FIXED VALUES: post cleaning -------------------------------------------
# Characters whose presence marks a title as a notice/advert.
SPECIAL_TITLE_CHARS = "【】$"
# The forum's own house account.
HOUSE_ACCOUNT = "股吧"
# Author-name suffix of news/information accounts.
NEWS_AUTHOR_SUFFIX = "资讯"
# Minimum shared-substring length with the stock-name string that marks an advert.
NAME_OVERLAP_MIN = 4
# Trading-session bounds, both ends open: 09:00 < t < 17:00.
SESSION_START_SECONDS = 9 * 3600
SESSION_END_SECONDS = 17 * 3600
# Cut-off time of day used by the page-prefix crawl: end_date 13:10.
PAGE_CUTOFF_HOUR = 13
PAGE_CUTOFF_MINUTE = 10
# Default forum board code (Shanghai composite index board).
DEFAULT_BOARD_CODE = "zssh000001"

# ---- FIXED VALUES: sectors -------------------------------------------------
SECTOR_SOURCE = "同花顺"
SECTOR_TYPES = {"thshy": "行业板块", "gn": "概念板块"}

# ---- FIXED VALUES: model input ---------------------------------------------
SEQUENCE_LENGTH = 40

# ---- FIXED VALUES: stop-word placeholders appended to any stop-word list ----
STOPWORD_PLACEHOLDERS = ["XXX", "YYY"]

# ---- FIXED VALUES: sentiment lexicons (one term per line in the originals) -
BEARISH_TERMS = [
    "跳水", "缺席", "快跑", "神奇", "2:00", "2点", "两点", "二点", "2:30", "2点半",
    "两点半", "二点半", "准时", "完了", "马上绿", "忽悠", "没量", "无量", "缩量", "诱多",
    "出货", "低走", "唉", "管住手", "千万不要", "千万别", "追", "注意", "谨防", "风险",
    "控制仓位", "下来吧", "跳吧", "不要装了", "别装了", "别装", "别死撑", "飞流直下", "下跌趋势", "下跌中继",
    "下跌", "必跌", "完蛋", "套", "清仓", "空仓", "离场", "逃命", "割肉", "行情结束",
    "暴跌", "撤退", "撤了", "跑了", "不玩了", "回调", "闷杀", "休息", "高位横盘", "久盘必",
    "顶背离", "到顶", "见顶", "双头", "接盘", "骗", "还要调整", "拉指数", "拉银行", "老乡",
    "韭菜", "没戏", "拜拜", "撤！",
]
BULLISH_TERMS = [
    "跑步", "新高", "调整结束", "拉升", "买入", "加仓", "梭哈", "满仓", "耐心", "涨停",
    "长阳", "打爆空头", "冲啊", "冲冲冲", "发力", "站上", "进场", "起飞", "上车", "买买买",
    "上攻", "牛市来",
]

# Labels written by the lexicon labeller.
LABEL_PUT = "put"
LABEL_CALL = "call"
LABEL_UNKNOWN = "unknown"
