"""Patterns and word lists of the text checks.

Patterns are written for Java and RE2 alike: white space and digits are spelled out, the end of text is ``\\z``.
"""

# White space as Unicode text processing has it.
WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STRIP = rf"^[{WS}]+|[{WS}]+\z"
CJK = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}"
CJK_KANA = CJK + r"\x{3040}-\x{30ff}\x{3005}\x{3007}"

# Citation marks. Integrity checks accept ranges after the first part, text statistics don't.
CITATION = rf"\[([0-9]+(?:[{WS}]*[-–—][{WS}]*[0-9]+)?(?:[{WS}]*[,，][{WS}]*[0-9]+(?:[{WS}]*[-–—][{WS}]*[0-9]+)?)*)\]"
CITATION_PLAIN = rf"\[[0-9]+(?:[{WS}]*[-–—][{WS}]*[0-9]+)?(?:[{WS}]*[,，][{WS}]*[0-9]+)*\]"
# An entry of a reference list with all that follows up to the next one, and what stands for a missing one.
ENTRY = rf"(?msd)^\[([0-9]+)\][{WS}]*(.+?)(?=\n\[[0-9]+\]|\z)"
MISSING_ENTRY = ("[待补：原编号 ", " 的文献条目缺失]")
NOTE_MARK = r"\[\^([0-9]+)\]"
NOTE_ANY = r"\[\^[0-9]+\]"
NOTE_LINE = rf"^[{WS}]*\[\^[0-9]+\][{WS}]*:"
NOTE_HEAD = r"^\[\^([0-9]+)\]:"
REFS_HEADING = "## 参考文献"
ABSTRACT_LINE = rf"^#{{1,3}}[{WS}]*摘[{WS}]*要[{WS}]*\z"
# Headings that part a text, as they stand in the whole of it. White space may hold line ends.
REFS_HEAD = rf"#{{1,3}}[{WS}]*参考文献[{WS}]*"
ABSTRACT_HEAD = rf"#{{1,3}}[{WS}]*摘[{WS}]*要[{WS}]*"
HEADING_LINE = rf"^#{{1,6}}[{WS}]"
NOISE = r"^(?:#|\||>|```|[-*]{3,})"
NOISE_NO_HEADING = r"^(?:\||>|```|[-*]{3,})"
# What is dropped before sentences are measured and compared.
PUNCT = rf"[{WS}。、，；：！？（）《》〈〉【】“”‘’«»—–…·\[\]()\-~.,!?;:'\"]+"

# Numbered headings, in the Arabic and in the Chinese way.
HEADINGS = {
    "arabic_1": rf"^#{{2,4}}[{WS}]*[0-9]+[{WS}]+[^{WS}]",
    "arabic_2": rf"^#{{2,4}}[{WS}]*[0-9]+\.[0-9]+",
    "chinese_1": rf"^#{{2,4}}[{WS}]*[一二三四五六七八九十]+、",
    "chinese_2": rf"^#{{2,4}}[{WS}]*（[一二三四五六七八九十]+）",
}

# Phrases of mechanical writing.
AI_WORDS = ["值得注意的是", "综上所述", "毋庸置疑", "应当指出", "不仅如此", "具有重要意义", "发挥着重要作用", "提供了重要参考", "具有里程碑意义", "深入研究", "系统梳理", "全面分析", "积极意义", "不断完善", "日益凸显", "亟待解决", "蓬勃发展", "从根本上说", "不可忽视", "在此基础上", "与此同时", "进一步", "极其", "至关重要", "总的来说", "总而言之"]
# Attributions without a source.
VAGUE = ["学界普遍认为", "学界普遍主张", "学界普遍", "学界认为", "学界已达成共识", "通说认为", "按照通说", "一般认为", "通常认为", "多数学者认为", "大多数学者认为", "有学者指出", "有学者认为", "有观点认为", "主流观点认为", "普遍认为", "众所周知"]
# Inflated claims, by category.
INFLATION = {
    "案例重要性膨胀": ["里程碑式", "里程碑意义", "标志性意义", "标志性判决", "开创性", "重大突破", "历史性意义", "划时代", "辐射效应", "示范效应"],
    "政策／理论意义虚高": ["深远的理论与实践意义", r"深远[^\n]{0,4}意义", "理论与实践意义", "重要参考", "积极意义", "坚实基础", "重要价值", "重大贡献", "重要借鉴", "有所裨益", r"具有[^\n]{0,6}(?:重大|重要)[^\n]{0,4}意义"],
    "学术贡献夸大": [r"填补[^\n]{0,10}空白", r"尚无[^\n]{0,6}研究", "尚无人", "首次从", "独创", r"开辟[^\n]{0,6}新路径", "率先提出", "前所未有", "开创了", r"学界[^\n]{0,6}(?:无人|尚未)"],
}
# Formulaic summaries, and filler phrases of the trace scan.
FORMULAIC = ["综上所述", "通过上述分析", "基于以上讨论", "由此可知", "通过以上分析", "以上分析表明", "如上所述"]
FILLER = ["在当前的背景下", "在此基础之上", "不可忽视的是", "从某种意义上说", "毫无疑问", "不言而喻", "简而言之", "具体来说", "总而言之", "在很大程度上", "总的来说"]
# Filler patterns of the redundancy check, and their labels.
FILLER_PATTERNS = [
    ("值得注意的是", "值得注意的是"), ("需要指出的是|需要说明的是", "需要指出/说明的是"), ("不难(?:看出|发现|理解)", "不难看出/发现"),
    ("显而易见|不言而喻", "显而易见/不言而喻"), ("换言(?:之|句话)", "换言之/换句话说"), ("从这个?(?:意义|角度)(?:上|来说|看)", "从这个意义上/角度"),
    ("就此而言|就前述而言", "就此而言"), ("综上所述|一言以蔽之|总而言之|归根结底", "综上所述/归根结底"), ("由此可见", "由此可见"),
    ("如前所述|上文已述|如前文所述", "如前所述"), ("本章将|本节将|下文将|本文将", "本章/本节/本文将"), ("在一定程度上|从某种意义上", "在一定程度上"), ("事实上|实际上", "事实上/实际上"),
]
# An author who names themselves.
FIRST_PERSON = "笔者认为|笔者主张|本人认为"

# What redacted text looks like, and the rules for personal data: category, severity, name, pattern.
REDACTED = r"[××Xx]{2,}|某某|某大学|某学院|○○|000000|0{6}|[【\[][WS]*(?:作者|姓名|单位|待填写|待补|来源|日期)[^】\]]*[】\]]|example\.com|user@|your[_-]?name|<[^>]{1,20}>".replace("[WS]", f"[{WS}]")
_W = r"[\p{L}\p{N}_"
PII_RULES = [
    ("联系方式", "高", "邮箱地址", rf"{_W}.+-]+@{_W}-]+\.{_W}.]{{2,}}"),
    ("联系方式", "高", "中国大陆手机号", r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])"),
    ("联系方式", "高", "身份证号", r"(?<![0-9])[1-9][0-9]{5}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx](?![0-9])"),
    ("联系方式", "中", "QQ号/长数字串", r"(?<![0-9])[1-9][0-9]{7,10}(?![0-9])"),
    ("本地路径", "高", "Windows 绝对路径（含机器用户名）", rf"[A-Za-z]:[\\/](?:Users|用户)[\\/][^\\/{WS}\"']+"),
    ("本地路径", "中", "盘符绝对路径", rf"(?<![\p{{L}}\p{{N}}_.])[A-Za-z]:[\\/][^{WS}\"'<>|`]{{4,}}"),
    ("本地路径", "中", "Unix 家目录路径", r"/(?:home|Users)/[A-Za-z0-9._-]+/"),
    ("单位信息", "高", "作者单位字段（最可能是你自己的单位）", rf"(?:作者|单位|通讯地址|联系地址|所在单位)[{WS}]*[:：]?[{WS}]*[（(]?[{WS}]*[\x{{4e00}}-\x{{9fff}}]{{4,20}}(?:大学|学院|研究院)"),
    ("身份信息", "中", "作者字段后的人名", rf"(?:作者|姓名|著作人|执笔人)[{WS}]*[:：][{WS}]*[\x{{4e00}}-\x{{9fff}}]{{2,4}}"),
    ("未发表内容", "中", "「以……为中心」式自拟标题", r"《[^》]{4,30}》[^\n]{0,10}(?:研究|探析|分析|论)[^\n]{0,25}(?:——|--)[^\n]{0,30}"),
    ("单位信息", "中", "英文机构名（含校名缩写）", rf"(?:[A-Z][a-z]+[{WS}]+){{1,4}}(?:of[{WS}]+)?[A-Z][a-z]+[{WS}]*,?[{WS}]*[A-Z]{{2,6}}\b"),
    ("单位信息", "中", "英文单位行含校名缩写", r"\b(?:University|College|Institute|School|Academy)\b[^\n]{0,40}?\b[A-Z]{2,8}\b"),
]
# What the name of an institution looks like.
INSTITUTION = r"[\x{4e00}-\x{9fff}]{2,6}(?:大学|学院|研究院)"
# Pieces of words that name no institution, and marks of a citation.
NO_INSTITUTION = ["的", "到", "是", "在", "和", "与", "或", "等", "用", "写", "为", "从", "对", "把", "被", "让", "使", "由", "向", "以", "将", "该", "本", "此", "各", "某", "所", "能", "可", "应", "需", "要", "国内", "国外", "境外", "知名", "重点", "普通", "民办", "公办", "中国", "全国", "各大", "法学", "政法", "财经", "师范", "医科"]
CITATION_SIGNS = ["参见", "载《", "载于", "出处", "出版社", "学报", "期刊", "学位论文", "硕士", "博士", "编译", "译", "[J]", "[M]", "[D]", "第", "页", "年", "期"]
# Surnames that the rule for names after an author field accepts.
SURNAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华"
    "金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方"
    "俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅"
    "皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明臧"
    "计伏成戴谈宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危"
    "江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯昝管卢莫"
    "经房裘缪干解应宗丁宣贲邓郁单杭洪包诸左石崔吉钮龚程嵇邢滑"
    "裴陆荣翁荀羊於惠甄曲家封芮羿储靳汲邴糜松井段富巫乌焦巴弓"
    "牧隗山谷车侯宓蓬全郗班仰秋仲伊宫宁仇栾暴甘钭历戎祖武符刘"
    "景詹束龙叶幸司韶郜黎蓟薄印宿白怀蒲邰从鄂索咸籍赖卓蔺屠蒙"
    "池乔阴胥能苍双闻莘党翟谭贡劳逄姬申扶堵冉宰郦雍卻璩桑桂濮"
    "牛寿通边扈燕冀郏浦尚农温别庄晏柴瞿阎充慕连茹习宦艾鱼容向"
    "古易慎戈廖庾终暨居衡步都耿满弘匡国文寇广禄阙东欧殳沃利蔚"
    "越夔隆师巩厍聂晁勾敖融冷訾辛阚那简饶空曾毋沙乜养鞠须丰巢"
    "关蒯相查后荆红游竺权逯盖益桓公"
)

# Keys of the header block of a manuscript, and marks of unfinished work.
META_KEYS = ["题目", "副标题", "作者", "基金项目", "引注体例", "篇幅", "目标期刊", "页眉", "写作状态", "篇幅目标", "字数目标", "评审轮次", "说明", "备注", "写作说明", "版本", "轮次", "日期", "字数"]
LAYOUT_KEYS = META_KEYS[:8]
TODO = r"\[(?:待核|待补|需用户核实|待确认|TODO)\]"
PLACEHOLDER = r"【(?:新京报|广州日报|[^】]{1,12})】"
COMMENT = r"<!--(?s:.*?)-->"

# Field codes of the two tagged export formats.
REFWORKS = {"RT": "type", "A1": "authors", "T1": "title", "JF": "journal", "YR": "year", "vo": "volume", "IS": "issue", "OP": "pages", "K1": "keywords", "DO": "doi", "AB": "abstract"}
REFWORKS_OTHER = ["sr", "a2", "a3", "ad", "t2", "t3", "jo", "pp", "pd", "pb", "rp", "id", "av", "et", "wt", "ol", "cl", "sn", "cn", "la", "ds", "lk", "vo", "is", "yr", "op", "k1", "do", "ab", "jf", "t1", "a1", "rt"]
ENDNOTE = {"%0": "type", "%A": "authors", "%T": "title", "%J": "journal", "%D": "year", "%V": "volume", "%N": "issue", "%P": "pages", "%K": "keywords", "%R": "doi", "%X": "abstract"}
TITLE_ASIDE = rf"[{WS}《》〈〉“”\"'’‘·：:，,。.、\-—–（）()\[\]【】]"
ENTRY_ASIDE = rf"[{WS}\"'“”‘’]"
