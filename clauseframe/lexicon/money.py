"""Money terms of rental agreements in Hebrew: what is paid, by whom, when, and what lateness costs."""

from __future__ import annotations

from .hebrew import CONCEPTS
from .phrases import any_of, either, near, then

#: Month names. Fixed values.
MONTHS = {"ינואר": 1, "פברואר": 2, "מרץ": 3, "מרס": 3, "אפריל": 4, "מאי": 5, "יוני": 6, "יולי": 7, "אוגוסט": 8, "ספטמבר": 9, "אוקטובר": 10, "נובמבר": 11, "דצמבר": 12}
#: Day, month, year, the month by name or by number.
NAMED_DATE = rf"(?<!\d)(\d{{1,2}})\s+(?:ב|ל)?({'|'.join(MONTHS)})\s+(\d{{4}})"
NUMERIC_DATE = r"(?<![\d./])(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})(?![\d])"
START = any_of("החל מיום", "מיום", "מתאריך", "החל בתאריך", "תחילת שכירות", "תחילת תקופה", "תתחיל ביום")

_PAYS = ("ישלם", "תשלם", "ישא", "יישא", "תישא", "תשא", "אחראי", "אחראית")


def payer(*parties: str) -> str:
    """A party that pays, is charged, or whose account a cost goes to."""
    told = [f"{p} {verb}" for p in parties for verb in _PAYS] + [f"{verb} {p}" for p in parties for verb in _PAYS]
    return any_of(*told, *(f"{how} {p}" for p in parties for how in ("על חשבון", "חל על", "יחול על", "יחולו על", "תחול על", "על ידי")))


LANDLORD_PAYS = payer("משכיר", "משכירה", "בעל דירה", "בעלת דירה")
TENANT_PAYS = payer("שוכר", "שוכרת")
#: Running charges; the names of kinds are fixed values.
CHARGES = {
    "ARNONA": any_of("ארנונה"),
    "WATER": any_of("מים"),
    "ELECTRICITY": any_of("חשמל"),
    "GAS": any_of("גז"),
    "VAAD_BAYIT": any_of("ועד בית", "דמי ועד", "מיסי ועד"),
    "BUILDING_INSURANCE": any_of("ביטוח מבנה", "פוליסת מבנה"),
    "SPECIAL_BUILDING_EXPENSES": any_of("הוצאות מיוחדות", "הוצאה מיוחדת", "שיפוץ בניין"),
    "CONTENTS_INSURANCE": any_of("ביטוח תכולה", "פוליסת תכולה"),
}
#: kind -> (pattern, when it is paid)
ONE_TIME = {
    "BROKER_FEE": (any_of("דמי תיווך", "עמלת תיווך", "שכר מתווך"), "START"),
    "LEGAL_FEE": (any_of("שכר טרחה", "שכר טרחת", "עריכת חוזה", "עריכת הסכם"), "START"),
    "CLEANING": (any_of("ניקיון", "ניקוי"), "END"),
}
MONTHLY, YEARLY, RENEWAL = any_of("כל חודש", "מדי חודש", "חודשית"), any_of("אחת לשנה", "פעם בשנה", "כל שנה", "מדי שנה", "שנתי", "שנתית"), CONCEPTS["OPTION"]
FLOOR = any_of("לא יפחת*", "לא תפחת", "לא ירד*", "לא יקטן")
LATE_VACATING = near(any_of("איחור", "עיכוב", "אי פינוי", "לא יפנה", "לא תפנה", "לא פינה"), any_of("פינוי", "לפנות", "דירה", "מושכר"), 40)
LATE_PAYMENT = any_of("איחור תשלום", "איחור בכל תשלום", "פיגור תשלום", "תשלום באיחור", "ריבית פיגורים", "דמי פיגורים")
DAILY, BY_YEAR = any_of("כל יום", "ליום", "יומי", "יומיים"), any_of("לשנה", "שנתית")
PER_DAY = any_of("כל יום", "ליום")
MULTIPLE = rf"(?<!\p{{L}})פי\s+(\d+(?:\.\d+)?|\p{{L}}+)\s+{any_of('דמי שכירות יומי*', 'שכר דירה יומי', 'שכירות יומית')}"
#: Rent that goes on until the agreed end.
RENT_TO_END = then(then(any_of(*_PAYS, "לשלם"), CONCEPTS["RENT"], 20), any_of("עד תום", "עד סוף", "עד סיום"), 40)
BUILDING_COSTS = either(CHARGES["BUILDING_INSURANCE"], CHARGES["SPECIAL_BUILDING_EXPENSES"])
