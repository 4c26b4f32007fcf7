"""Patterns, keyword lists and enumerations of the domain. They must be as they are for right results."""

SUBJECT_BLACKLIST = [
    r"^\s*Undeliverable\b", r"^\s*Delivery Status Notification\b", r"^\s*Out of Office\b", r"^\s*Automatic\s+Reply\b", r"^\s*Auto\s*Reply\b", r"^\s*系统自动回复\b", r"^\s*您的验证码\b",
    r"^\s*Verify\s+your\b", r"^\s*Security\s+alert\b", r"^\s*安全提醒\b", r"^\s*订阅确认\b", r"^\s*Unsubscribe\b", r"^\s*退信\b", r"^\s*Mail Delivery Subsystem\b",
]
SENDER_BLACKLIST = [r"postmaster@", r"mailer-daemon@"]
SYSTEM_DOMAINS = ["editrack.com"]
STYLE_PATTERNS = [r"\bCCSS\d{5,6}[A-Z]?\b", r"\bINDO[A-Z]\d{3,6}\b", r"\bAW\d{2}-[A-Z]+\d+\b", r"\bAW\d{2}[A-Z]+\d+\b", r"\bSS\d{2}[A-Z]+\d+\b", r"\bCCAW\d{5,6}\b", r"\bCDIB\d+\b", r"\b\d{7}\b"]
P_SERIES = r"\bP\d{3}-[A-Z0-9]+-\d+\b"
LOOSE_STYLE_PATTERNS = [r"[A-Z]{2}\d{0,2}-[A-Z]+\d+", r"[A-Z]{2}\d{0,2}[A-Z]+-\d+", r"[A-Z]{2,}\d+-\d+", r"[A-Z]{2}\d{0,2}[A-Z]+\d+", r"[A-Z]{3,}\d{4,}", r"[A-Z]{3,}\d{3,}", r"\b\d{7,9}\b"]
BUSINESS_KEYWORDS = [
    "CCSS", "INDO", "AW", "SS", "CCAW", "CDIB", "样衣", "面料", "出货", "延期", "封样", "核料", "纸样", "试身", "修改", "产前", "测试", "船样", "验货", "开裁",
    "确认", "提交", "批复", "给意见", "回传", "查货", "sample", "fabric", "shipment", "fitting", "pattern", "lab dip", "pp sample", "bulk", "delivery", "qc",
]
SIGNATURE_MARKERS = [r"^\s*[-=_]{2,}\s*$", r"^\s*Best regards\s*[,.]?\s*$", r"^\s*Regards\s*[,.]?\s*$", r"^\s*Thanks\s*[,.]?\s*$", r"^\s*谢谢\s*[,.!?]?\s*$", r"^\s*此致\s*[,.]?\s*$", r"^\s*Tel[:\s]", r"^\s*Email[:\s]", r"^\s*地址[:\s]", r"^\s*发件人\s*[:：]"]
FORWARD_MARKERS = [r"^\s*[-]+\s*Original Message\s*[-]+", r"^\s*From:\s*", r"^\s*To:\s*", r"^\s*Sent:\s*", r"^\s*Subject:\s*", r"^\s*主题\s*[:：]", r"^\s*收件人\s*[:：]"]
REPLY_PREFIX = r"(?i)^(回复:|Re:|答复:|Fw:|转发:)\s*"
CATEGORIES = ["调纸样", "核料", "面辅料价格", "工价", "试身样", "修改样", "封样", "产前样", "测试样", "船样", "定面料", "定辅料", "产前会议", "开裁", "验货", "出货", "补货", "Lab Dip", "大货样", "样衣", "面料", "大货订单", "一般沟通", "其他"]
EVENT_TYPES = ["提交", "确认", "回传", "出货", "延期申请", "给意见", "批复", "打样", "修改", "完成", "邮寄", "等待反馈", "补货", "抽查", "其他"]
CATEGORY_KEYWORDS = {
    "调纸样": ["调纸样", "纸样", "pattern", "pattern making"],
    "核料": ["核料", "fabric booking", "material booking", "consumption"],
    "面辅料价格": ["面辅料价格", "fabric price", "trim price", "quotation", "quote"],
    "工价": ["工价", "cmc", "cut make cost", "factory price", "加工费"],
    "试身样": ["试身样", "fit sample", "fitting sample", "size set"],
    "修改样": ["修改样", "revised sample", "correction", " amended sample"],
    "封样": ["封样", "sealed sample", "pp sample", "pre-production sample", "top sample"],
    "产前样": ["产前样", "pre-production", "pilot run", "trial production"],
    "测试样": ["测试样", "test sample", "bulk sample", "production sample", "大货样"],
    "船样": ["船样", "shipment sample", "shipping sample", "final sample"],
    "定面料": ["定面料", "fabric order", "fabric po", "面料采购"],
    "定辅料": ["定辅料", "trim order", "accessory order", "辅料采购"],
    "产前会议": ["产前会议", "pre-production meeting", "pp meeting"],
    "开裁": ["开裁", "cutting", "fabric cutting", "laying"],
    "验货": ["验货", "inspection", "qc", "quality check", "查货"],
    "出货": ["出货", "shipment", "delivery", "交期", "shipping", "dispatch"],
    "补货": ["补货", "replenishment", "reorder", "additional order"],
    "Lab Dip": ["labdip", "lab dip", "色卡", "手刮", "颜色确认", "color dip"],
    "样衣": ["样衣", "sample", "prototype", "mock-up"],
    "面料": ["面料", "fabric", "里料", "辅料", "lining", "textile"],
    "大货订单": ["大货订单", "bulk order", "production order", "po"],
}
ROUTE_KEYWORDS = {
    "overview": ["进展", "情况", "怎么样", "状态", "概览", "总览", "summary", "overview", "status"],
    "temporal": ["延期", "delay", "推迟", "late", "逾期", "deadline", "交期", "时间线", "timeline"],
    "relational": ["合作", "协作", "和谁", "同事", "下属", "汇报", "collaborat", "team", "partner"],
    "semantic": ["怎么", "如何", "what is", "什么是", "问题", "issue", "problem", "处理", "解决"],
    "entity": ["船样", "样衣", "面料", "拉链", "纽扣", "生产", "大货", "辅料", "色卡", "色样"],
}
SCOPE_KEYWORDS = {
    "面料": ["面料", "布料", "lab dip", "色卡", "色样"], "样衣": ["样衣", "船样", "产前样", "pp sample", "top", "fitting"], "调纸样": ["纸样", "打版", "pattern", "版型"],
    "大货": ["大货", "生产", "出货", "delivery", "bulk"], "拉链": ["拉链", "zipper", "拉头"], "纽扣": ["纽扣", "扣子", "button"],
}
CONTINUATION = ["剩下的", "还有吗", "继续", "然后呢", "接着", "下一页", "更多", "其余的", "未完", "看看剩下的", "还有呢", "接着看", "后面", "剩余"]
PRONOUNS = ["那款", "这个", "它", "这款", "该款", "此款"]
GREETINGS = ["你好", "您好", "嗨", "hello", "hi"]
CONTINUATION_ALONE = ["续", "继", "查", "看"]
EVENT_FOCUS = {
    "延期": ["延期", "延迟", "晚", "赶不及", "还能.*出货", "为什么.*延期", "根因", "原因"], "样衣": ["样衣", "sample", "打样", "试穿"], "封样": ["封样", "签字样", "sealed", "approval sample"],
    "面料": ["面料", "布料", "fabric", "lab dip", "色卡"], "出货": ["出货", "发货", "shipment", "ship", "delivery"], "拉链": ["拉链", "zipper", "拉锁"], "尺寸": ["尺寸", "尺码", "规格", "size", "measurement"],
    "客户回复": ["客户回复", "客人回复", "客户意见", "客人确认", "feedback"], "工厂问题": ["工厂问题", "工厂反映", "工厂困难", "factory issue"], "Lab Dip": ["lab dip", "色卡", "染色小样"], "面料确认": ["面料确认", "布料确认"],
}
TERM_STOPWORDS = ["the", "and", "for", "with", "this", "that", "from", "have", "been", "were", "are", "you", "your", "will", "请", "谢谢", "您好", "关于", "如下", "如下所示"]
ROLE_WORDS = ["未知", "工厂", "客人", "供应商"]
UNKNOWN_PARTY, OTHER = "未知", "其他"
