"""Word lists and name maps.

Everything in this file is a fixed value: results only agree with existing
dashboards if these lists are kept exactly as they are.
"""

# --- fixed values: stop words dropped before counting words -----------------
STOP_WORDS = (
    "的", "了", "是", "我", "你", "他", "她", "它", "我们", "你们", "他们", "和", "或", "但是", "所以",
    "都", "也", "很", "非常", "不", "没有", "有", "个", "这", "那", "一个", "什么", "怎么", "哪里",
    "谁", "什么时候", "好", "不好", "大", "小", "多", "少", "一点", "一些", "很多", "很少",
    "哈哈", "哈哈哈", "呵呵", "嗯", "啊", "哦", "啦", "呀", "吗", "呢", "吧", "嘛",
    "就是", "然后", "还有", "这个", "那个", "那些", "这些", "什么样",
    "可以", "要", "会", "能", "想", "觉得", "认为",
    "几时", " ", "怎样", "为何",
    "！", "，", "。", "？", "、", "；", "：", "“", "”", "（", "）", "【", "】", "<", ">", "/", "\\", "~", "`",
    "@", "#", "$", "%", "^", "&", "*", "+", "=", "|", "{", "}", "[", "]", ":", ";", "'", "\"",
    "\n", "\t",
    "回复", "转发", "点赞", "评论", "分享",
    "原创", "内容", "微博",
)

# --- fixed values: words that flip the polarity of the next word ------------
NEGATIONS = ("不", "没", "无", "未", "别", "莫", "从未", "不会")

# --- fixed values: location names as written -> names on the province map ---
PROVINCE_ALIASES = {"中国台湾": "台湾", "中国澳门": "澳门", "中国香港": "香港"}
