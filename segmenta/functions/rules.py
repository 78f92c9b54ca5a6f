"""Rule tables for transcripts and translations. They are data: callers may bring their own."""

from __future__ import annotations

# Misheard wordings and what they should be, of speech and singing in general, and of songs.
HOMOPHONES = [
    ("想遇个", "相遇"), ("想遇", "相遇"), ("根本吸不掉", "根本洗不掉"), ("吸不掉回忆", "洗不掉回忆"), ("一硬地动", "隐隐地动"),
    ("一硬地", "隐隐地"), ("已没家", "已没有家"), ("淚不剩落下", "泪不想落下"), ("泪不剩落下", "泪不想落下"), ("不剩落下", "不想落下"),
    ("脸颊里的发", "脸你的发"), ("加你的发", "你的发"), ("脸加你的", "脸你的"), ("那些幸福剩", "那些幸福啊"), ("幸福剩大家", "幸福啊"),
    ("在那个时间", "在那个瞬间"), ("那个时间是个", "那个瞬间是个"), ("说杰伦", "周杰伦"), ("文山的磁", "文山的词"), ("飞吼过", "飞过"),
    ("爱在七元前", "爱在西元前"), ("听成爱在七元前", "听成爱在西元前"), ("兴开年错温", "新概念作文"), ("连城县", "连呈现"), ("連城縣", "連呈現"),
    ("歲月深聽", "歲月深情"), ("岁月深听", "岁月深情"),
]
SONGS = [
    ("想爱过", "如果爱忘了"), ("如果是爱了", "要是忘了"), ("爱够久了", "爱够久了"), ("分开月灯", "分开的话"), ("分开月灯吧", "分开的话"),
    ("加你的", "你的"), ("想遇个", "相遇"), ("一硬地动", "隐隐地震"), ("在那个时间", "在那个瞬间"), ("必须要处理", "必须要坚强"),
    ("已没家", "已没有家"), ("淚不剩落下", "泪不想落下"), ("泪不剩落下", "泪不想落下"), ("幸福 提升大家", "幸福啊 让她给我吧"), ("幸福提升大家", "幸福啊 让她给我吧"),
    ("根本吸不掉", "根本洗不掉"), ("心里面有啦", "心里面了"), ("碰它却", "碰它却"),
]

# Traditional characters and simplified ones, place by place.
TRADITIONAL = (
    "們來這個項討論進語聲還嗎聽質說話員對於與為會後從種國業發現時間開關東車電腦網絡計劃優選擇準備實驗錄頻穩離昇壓態據處裡麼隻並萬讓該認識"
    "請問題點樣沒錯經過產傳統複雜簡單總結續聯調測試給妳係佈佔餘臺灣區塊碼雙專務"
)
SIMPLIFIED = (
    "们来这个项讨论进语声还吗听质说话员对于与为会后从种国业发现时间开关东车电脑网络计划优选择准备实验录频稳离升压态据处里么只并万让该认识"
    "请问题点样没错经过产传统复杂简单总结续联调测试给你系布占余台湾区块码双专务"
)
# The same for the form in which keywords are compared.
COMPARED = [
    ("鋼琴", "钢琴"), ("練習", "练习"), ("歲月", "岁月"), ("磁帶", "磁带"), ("時代", "时代"), ("詞", "词"), ("憶", "忆"), ("聽", "听"), ("見", "见"),
    ("寫", "写"), ("記", "记"), ("電", "电"), ("競", "竞"), ("過", "过"),
]

# Phrases with translations that are known to be right.
PHRASES = {
    "你好": "Hello",
    "今天我们来讨论一下这个项目的进度": "Let's discuss the project progress today",
    "好的，我这边算法模块已经跑通了": "Okay, the algorithm module is already running on my side",
    "目前语音克隆还分不太清不同说话人，听感也一般": "Currently voice cloning still cannot tell speakers apart, and quality is only okay",
    "目前语音克隆还分不太清不同说话人": "Currently voice cloning still cannot tell speakers apart",
    "目前语音克隆还分": "Currently voice cloning still",
    "太清不同说话人": "cannot clearly tell different speakers",
    "听感也一般": "and the listening quality is only average",
    "是的，我建议先优化说话人分离和参考音绑定": "Yes, I suggest optimizing speaker diarization and reference binding first",
    "那我们先把说话人分离做稳，再提升克隆质量": "Then let's stabilize speaker separation first, then improve clone quality",
    "那我们先把说": "Then let's first",
    "那我们先把说话人分离坐": "Then let's stabilize speaker separation",
    "那我们先把说话人分离坐稳": "Then let's stabilize speaker separation",
    "话人分离坐稳": "stabilize speaker separation",
    "再提升克隆质量": "then improve clone quality",
    "同意，我准备一段双人对话样例做验收": "Agreed, I will prepare a two-speaker dialogue sample for acceptance",
    "好的，那今天就先这样，下午继续联调": "Alright, that's it for today, we continue integration this afternoon",
    "没问题，我把测试音频和结果摘要发你": "No problem, I will send you the test audio and the result summary",
}

_STEADY = "坐稳|分离坐|说话人分离|分离做稳"
# Rewrites of English translations: a pattern of the source (or none), a pattern of the text, its replacement.
QUALITY = [
    (_STEADY, r"\bseparate(?:\s+the)?\s+speakers?\s+and\s+sit\s+down(?:\s+first)?\b", "stabilize speaker separation"),
    (_STEADY, r"\bsit\s+down(?:\s+first)?\b", "stabilize speaker separation"),
    (_STEADY, r"(stabilize speaker separation)(\s+and\s+\1)+", "$1"),
    (_STEADY, r"\bseparate(?:\s+the)?\s+speakers?\s+and\s+stabilize speaker separation\b", "stabilize speaker separation"),
    (None, r"\bTaiqing\b", "speakers"),
    (None, r"\btai\s*qing\b", "speakers"),
    ("听感|聽感", r"\bthe\s+listening\b(?!\s+quality)", "the listening quality"),
    ("坐稳|坐穩|分离坐|分離坐|分离做稳", r"\bseparate(?:\s+the)?\s+speakers?(?:\s+first)?\b", "stabilize speaker separation"),
    ("坐稳|坐穩|分离坐|分離坐|分离做稳", r"(stabilize speaker separation)(?:\s+and\s+then\s+stabilize speaker separation)+", "$1"),
    ("说话人分离|说话人分離", r"\bspeaker\s+isolation\b", "speaker diarization"),
    ("说话人分离|说话人分離", r"\bspeaker\s+splitting\b", "speaker separation"),
    ("语音克隆|語音克隆", r"\bvoice\s+reproduction\b", "voice cloning"),
    ("语音克隆|語音克隆", r"\bspeech\s+cloning\b", "voice cloning"),
    ("参考音|參考音", r"\breference\s+sound\b", "reference audio"),
    ("参考音|參考音", r"\breference\s+tone\b", "reference audio"),
    ("听感|聽感", r"\blistening\s+experience\b", "listening quality"),
    ("听感|聽感", r"\bthe\s+listening\b(?!\s+quality)", "the listening quality"),
]
AFTER_LENGTH = [
    ("听感|聽感", r"\bthe\s+listening\b(?!\s+quality)", "the listening quality"),
    ("听感|聽感", r"^(and )?the listening quality[.!]*$", "listening quality is only average"),
    ("坐稳|坐穩|分离坐|分離坐", r".*?\bsit\s+down(?:\s+first)?\b.*", "Then let's stabilize speaker separation"),
    ("坐稳|坐穩|分离坐|分離坐", r"\bseparate(?:\s+the)?\s+speakers?(?:\s+first)?\b", "stabilize speaker separation"),
    ("坐稳|坐穩|分离坐|分離坐", r"\bstabilize speaker separation\s+and\s+stabilize speaker separation\b", "stabilize speaker separation"),
]
LYRICS = [
    (None, r"\bthose happiness\b", "those happy times"),
    (None, r"\bthose happinesses\b", "those happy times"),
    (None, r"\blet'?s separate the moonlight\b", "maybe it's time we part"),
    (None, r"\bseparate the moonlight\b", "time to say goodbye"),
    (None, r"\bI want to have loved\b", "If love fades away"),
    (None, r"\bI want to meet someone I can'?t find\b", "some meetings never happen"),
    (None, r"\bthe listening\b(?!\s+quality)", "the memory"),
    (None, r"\badd your hair\b", "your hair"),
]
# How an answer begins that is no translation, and the words before the translation in it.
DECLINING, ANNOUNCED = ["I'm sorry", "I can't assist", "I cannot", "I apologize", "抱歉", "对不起", "无法", "不能", "Sure!", "Here is"], "(?:Translation|翻译)[：:]"
# Words in names of files that tell the language of their speech, English before Chinese.
NAMED_EN = ["talking_head", "willkent", "will_kent", "english", "_en_", ".en.", "wikidata", "wikipedia"]
NAMED_ZH = ["singing_", "ruguaiawang", "walkman", "xiaoxiong", "qianxia", "real_dialog", "dialog_", "fleurs"]
# Filler words of English that may go where a text is too long.
PADDING = r"\b(indeed|actually|really|just|very|quite|basically|literally|that is to say|for example|in order to|kind of|sort of|you know|I mean|well|so that)\b[,.]?"
