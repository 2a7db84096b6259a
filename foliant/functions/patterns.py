"""The fields of contracts, and the patterns that are tried for each in turn."""

from __future__ import annotations

import re

_DATE = r"\d{4}年\d{1,2}月\d{1,2}日"
_CAPITAL = "壹貳參肆伍陸柒捌玖拾佰仟萬億"

# Patterns by field, in order of precedence.
PATTERNS: dict[str, tuple[str, ...]] = {
    "contract_number": (r"合約(?:編號|字號|號碼)?[：:]\s*([A-Z0-9\-]+)", r"Contract\s+(?:No\.|Number)[：:]\s*([A-Z0-9\-]+)", r"(?:^|[^合約])編號[：:]\s*([A-Z0-9\-]+)"),
    "signing_date": (rf"(?:簽訂日期|立約日期|契約日期)[：:]\s*({_DATE})", r"中華民國\s+(\d{2,3})\s+年\s+(\d{1,2})\s+月\s+(\d{1,2})\s+日", r"中華民國(\d{2,3})年(\d{1,2})月(\d{1,2})日", r"(?:Date|Signing Date)[：:]\s*(\d{4}[-/]\d{1,2}[-/]\d{1,2})"),
    "effective_date": (rf"(?:生效日期|起始日期)[：:]\s*({_DATE})", r"生效日期[：:]\s*中華民國\s+(\d{2,3})\s+年\s+(\d{1,2})\s+月\s+(\d{1,2})\s+日", r"(?:簽訂後|合約簽署後)\s*([即立次]日|立即)\s*生效"),
    "party_a": (r"甲方[：:]\s*([^\n\r（(]+)", r"立合約書人[：:]?\s*([^\n\r（(]+)", r"(?:第一方|賣方|委託方)[：:]\s*([^\n\r（(]+)"),
    "party_b": (r"乙方[：:]\s*([^\n\r（(]+)", r"(?:第二方|買方|受託方)[：:]\s*([^\n\r（(]+)", r"相對方[：:]\s*([^\n\r（(]+)"),
    "party_a_address": (r"甲方(?:地址|住址|營業地址)?[：:]\s*([^\n\r]+(?:市|縣|區|路|街|巷|弄|號)[^\n\r]*)", r"(?:第一方|賣方)地址[：:]\s*([^\n\r]+)", r"地址[：:]\s*([^\n\r]+(?:市|縣|區|路|街|巷|弄|號)[^\n\r]*)"),
    "party_b_address": (r"乙方(?:地址|住址|營業地址)?[：:]\s*([^\n\r]+(?:市|縣|區|路|街|巷|弄|號)[^\n\r]*)", r"(?:第二方|買方)地址[：:]\s*([^\n\r]+)", r"(?:^|\n)地址[：:]\s*([^\n\r]+)"),
    "contract_amount": (r"(?:合約金額|總價|總金額|契約金額)[：:]\s*(?:新台幣|新臺幣|NTD|TWD)?\s*([\d,]+)\s*元", r"(?:總價|金額)[：:]\s*([\d,]+)\s*元整", r"Total\s+Amount[：:]\s*(?:TWD|NTD)?\s*([\d,]+)", rf"(?:合約金額|總金額)[：:]\s*(?:新台幣|新臺幣)?\s*([{_CAPITAL}]+)元整"),
    "currency": (r"幣別[：:]\s*(新台幣|新臺幣|美元|USD|TWD|NTD)", r"(新台幣|新臺幣|NTD|TWD|USD)\s*[\d,]+", r"Currency[：:]\s*(TWD|NTD|USD|EUR|JPY)"),
    "payment_method": (r"付款方式[：:]\s*([^\n\r]+)", r"Payment\s+Method[：:]\s*([^\n\r]+)", r"以\s*([^\n\r]+)\s*方式付款"),
    "payment_deadline": (rf"付款期限[：:]\s*({_DATE}(?:前|前)?)", r"(?:付款期限|給付期限)[：:]\s*(?:簽約|合約簽訂)後\s*(\d+)\s*(?:天|日|個工作天)", r"Payment\s+Deadline[：:]\s*([^\n\r]+)"),
    "date_start": (rf"租期[：:]\s*({_DATE})\s*(?:起|至)", rf"(?:起租日|租賃起始日|租期起算日)[：:]\s*({_DATE})", r"(?:租期|起租日)[：:]\s*中華民國\s*(\d{2,3})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", rf"自\s*({_DATE})\s*起(?:租|承租)"),
    "date_end": (rf"租期[：:]\s*{_DATE}\s*(?:至|迄|～)\s*({_DATE})", rf"(?:終止日|租期終止日|租賃終止日)[：:]\s*({_DATE})", r"(?:至|迄)\s*中華民國\s*(\d{2,3})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日(?:止|為止)", rf"(?:至|迄|～)\s*({_DATE})\s*(?:止|為止)"),
    "monthly_rent": (r"(?:每月租金|月租金|租金)[：:]\s*(?:新台幣|新臺幣|NTD|TWD)?\s*([\d,]+)\s*元", r"租金\s*(?:每月|月付)\s*(?:新台幣|新臺幣)?\s*([\d,]+)\s*元", rf"(?:每月租金|月租金)[：:]\s*(?:新台幣|新臺幣)?\s*([{_CAPITAL}]+)元整", r"(?:Monthly\s+)?Rent[：:]\s*(?:TWD|NTD)?\s*([\d,]+)"),
    "deposit": (r"(?:押金|保證金|履約保證金)[：:]\s*(?:新台幣|新臺幣|NTD|TWD)?\s*([\d,]+)\s*元", r"押金[：:]\s*(?:相當於|等同|為)\s*(\d+)\s*個月租金", rf"(?:押金|保證金)[：:]\s*(?:新台幣|新臺幣)?\s*([{_CAPITAL}]+)元整", r"(?:Deposit|Security\s+Deposit)[：:]\s*(?:TWD|NTD)?\s*([\d,]+)"),
    "rental_address": (r"(?:租賃標的|租賃房屋|房屋坐落|標的物)[：:]\s*([^\n\r]+(?:市|縣|區|路|街|巷|弄|號|樓)[^\n\r]*)", r"坐落(?:於|在|：|:)\s*([^\n\r]+(?:市|縣|區|路|街|巷|弄|號|樓)[^\n\r]*)", r"(?:房屋地址|物件地址|標的地址)[：:]\s*([^\n\r]+(?:市|縣|區|路|街|巷|弄|號|樓)[^\n\r]*)"),
    "tenant_name": (r"(?:承租人|房客|租賃人)[：:]\s*([^\n\r（(]+)", r"乙方[（(]承租人[）)][：:]\s*([^\n\r（(]+)", r"租客[：:]\s*([^\n\r（(]+)"),
    "tenant_id_number": (r"(?:承租人|乙方).*?身(?:分|份)證(?:字號|號碼)[：:]\s*([A-Z][0-9]{9})", r"身(?:分|份)證(?:字號|號碼)[：:]\s*([A-Z][0-9]{9})", r"(?:承租人|乙方).*?統一編號[：:]\s*([0-9]{8})"),
    "tenant_phone": (r"(?:承租人|乙方).*?(?:電話|聯絡電話|手機)[：:]\s*([\d\-\(\)]{8,15})", r"(?:承租人|乙方).*?(?:行動電話|手機號碼)[：:]\s*(09\d{2}[-\s]?\d{3}[-\s]?\d{3})", r"(?:電話|Tel|Phone)[：:]\s*([\d\-\(\)]{8,15})"),
    "landlord_name": (r"(?:出租人|房東|租賃人)[：:]\s*([^\n\r（(]+)", r"甲方[（(]出租人[）)][：:]\s*([^\n\r（(]+)"),
    "landlord_id_number": (r"(?:出租人|甲方).*?身(?:分|份)證(?:字號|號碼)[：:]\s*([A-Z][0-9]{9})", r"(?:出租人|甲方).*?統一編號[：:]\s*([0-9]{8})"),
    "landlord_phone": (r"(?:出租人|甲方).*?(?:電話|聯絡電話|手機)[：:]\s*([\d\-\(\)]{8,15})", r"(?:出租人|甲方).*?(?:行動電話|手機號碼)[：:]\s*(09\d{2}[-\s]?\d{3}[-\s]?\d{3})"),
    "management_fee": (r"(?:管理費|社區管理費)[：:]\s*(?:新台幣|新臺幣|NTD|TWD)?\s*([\d,]+)\s*元", r"(?:每月)?管理費\s*(?:每月|月付)\s*(?:新台幣|新臺幣)?\s*([\d,]+)\s*元"),
    "parking_fee": (r"(?:停車費|車位租金|停車位費用)[：:]\s*(?:新台幣|新臺幣|NTD|TWD)?\s*([\d,]+)\s*元", r"(?:每月)?停車費\s*(?:每月|月付)\s*(?:新台幣|新臺幣)?\s*([\d,]+)\s*元"),
    "payment_day": (r"(?:租金繳納日|繳租日|付款日)[：:]\s*(?:每月)?(?:第)?\s*(\d{1,2})\s*日", r"(?:租金繳納|繳租)[：:]\s*每月\s*(月初|月底|初|底)", r"於每月\s*(\d{1,2})\s*日(?:前|前)?(?:繳納|支付)"),
}
# Fields of high weight; the other 15 have low weight.
CRITICAL = ("contract_number", "party_a", "party_b", "contract_amount", "date_start", "date_end", "monthly_rent", "deposit", "rental_address", "tenant_name")
MINOR = tuple(f for f in PATTERNS if f not in CRITICAL)
# The groups of a result.
METADATA = ("contract_number", "signing_date", "effective_date")
PARTIES = ("party_a", "party_b", "party_a_address", "party_b_address")
TERMS = ("contract_amount", "currency", "payment_method", "payment_deadline")
GENERAL = METADATA + PARTIES + TERMS
RENTAL = tuple(f for f in PATTERNS if f not in GENERAL)
UNKNOWN_FIELD = "未知欄位"
# Names of the fields.
DESCRIPTIONS = {
    "contract_number": "合約編號", "signing_date": "簽訂日期", "effective_date": "生效日期", "party_a": "甲方", "party_b": "乙方", "party_a_address": "甲方地址", "party_b_address": "乙方地址",
    "contract_amount": "合約金額", "currency": "幣別", "payment_method": "付款方式", "payment_deadline": "付款期限", "date_start": "租期起始日", "date_end": "租期結束日", "monthly_rent": "月租金",
    "deposit": "押金", "rental_address": "租賃標的地址", "tenant_name": "承租人姓名", "tenant_id_number": "承租人身分證字號", "tenant_phone": "承租人電話", "landlord_name": "出租人姓名",
    "landlord_id_number": "出租人身分證字號", "landlord_phone": "出租人電話", "management_fee": "管理費", "parking_fee": "停車費", "payment_day": "租金繳納日",
}

# Candidates of transcript fields; the group that counts is 1, or 0 for the whole match.
CANDIDATES = {
    "land_number": ((r"地號[\s:：]*([0-9oOlI\-\s]{8,20})", 1), (r"(\d{4}[\s\-oOlI]{1,3}\d{4,8})", 1)),
    "date": ((r"民國\s*(\d{2,3})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", 0),),
    "area": ((r"面積[\s:：]*(\d+\.?\d*)\s*平方公[尺米]", 0),),
    "owner": ((r"所有權人[\s:：]*([^\n]{2,20})", 1),),
}
LAND_NUMBER_FORM = r"^\d{4}-\d{4,8}$"
TRANSCRIPT_LAND_NUMBER = r"(?:㆞|地)號[：:]\s*(\d{4}-\d{4})"
TRANSCRIPT_AREA = r"面\s*積[：:]\s*([\d,]+\.?\d*)\s*平方公尺"
# Forms of identities.
NATIONAL_ID, COMPANY_ID, MOBILE, PHONE = r"[A-Z][0-9]{9}", r"[0-9]{8}", r"09\d{2}[-\s]?\d{3}[-\s]?\d{3}", r"[\d\-\(\)]{8,15}"


def group_count(pattern: str) -> int:
    return re.compile(pattern).groups


_META = set(r"\.^$*+?()[]{}|")


def needed_words(pattern: str) -> tuple[str, ...]:
    """Words of which any text that matches has one: what the pattern begins with, as far as that is plain; () if it isn't."""
    depth = 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            return ()
    if pattern.startswith("(?:"):
        body = pattern[3 : pattern.find(")")]
        words = tuple(body.split("|"))
        plain = all(w and not _META & set(w) for w in words)
        return words if plain and pattern[pattern.find(")") + 1 : pattern.find(")") + 2] not in ("?", "*", "{") else ()
    word = ""
    for i, c in enumerate(pattern):
        if c in _META:
            return (word[:-1] if c in "?*{" else word,) if len(word) > (c in "?*{") else ()
        word += c
    return (word,) if word else ()
