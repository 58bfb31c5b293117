"""What the verdict rules and the early-exit terms look for, in rental agreements in Hebrew.

Each entry names its purpose: what a tenant who reads the clause would want to know.
"""

from __future__ import annotations

from .hebrew import CONCEPTS, NAMES
from .money import BUILDING_COSTS, ONE_TIME, RENT_TO_END, TENANT_PAYS  # noqa: F401  (TENANT_PAYS is one of the entries)
from .phrases import PREFIX, any_of, either, near, then

_TENANT = any_of("שוכר", "שוכרת")
_MAY = any_of("רשאי", "רשאית", "יוכל", "תוכל", "זכאי", "זכאית")
_MAY_NOT = any_of("אסור", "אין", "אינו רשאי", "אינה רשאית", "לא יהיה רשאי", "לא תהיה רשאית", "לא רשאי", "לא ישכיר", "לא תשכיר", "לא יעביר", "לא יכניס")
_WITHOUT = any_of("ללא", "בלי", "בלא")

#: Animals are forbidden.
PETS_BARRED = either(then(any_of("אסור", "איסור", "אין להחזיק", "אין להכניס", "לא יחזיק", "לא תחזיק", "לא יגדל"), CONCEPTS["PETS"], 50), any_of("no pets", "pets not allowed", "pets are not allowed"))
#: The home has no furniture.
UNFURNISHED = any_of("לא מרוהטת", "אינה מרוהטת", "בלתי מרוהטת", "ללא ריהוט", "ללא רהיטים")
#: A security is demanded; a choice among several is left.
DEMANDS_SECURITY = any_of("ימסור", "תמסור", "יפקיד", "תפקיד", "יעמיד", "תעמיד", "ימציא", "תמציא", "יחתום", "תחתום", "להבטחת", "יידרש", "תידרש")
OFFERS_CHOICE = any_of("או", "לחילופין", "לפי בחירת", "לבחירת")
#: Kinds of security; their names are fixed values.
SECURITY_KINDS = {
    "BANK_GUARANTEE": any_of("ערבות בנקאית", "bank guarantee"),
    "PROMISSORY_NOTE": any_of("שטר חוב", "שטרות חוב", "promissory note"),
    "CASH_DEPOSIT": any_of("פיקדון", "פקדון", "פיקדון כספי", "deposit"),
    "GUARANTOR": any_of("ערב", "ערבים", "guarantor"),
}
#: Rent follows an index, or is said not to.
RENT_INDEXED = near(CONCEPTS["RENT"], CONCEPTS["INDEXATION"])
NOT_INDEXED = any_of("לא צמוד*", "אינם צמודים", "אינו צמוד", "אינה צמודה", "לא יהיו צמודים", "לא יוצמד*", "ללא הצמדה")
BROKER_FEE = ONE_TIME["BROKER_FEE"][0]
#: The tenant cannot stay on.
NO_RENEWAL = either(then(any_of("אין", "לא תהיה", "לא תינתן", "ללא"), any_of("אופציה", "הארכה", "חידוש", "להאריך"), 30), any_of("לא יוארך", "לא תוארך", "לא יחודש"))
#: Nobody else may live there.
SUBLET_BARRED = then(_MAY_NOT, any_of(*NAMES["SUBLET"], "שותף", "שותפים", "דייר נוסף", "דיירים נוספים", "אדם אחר", "אנשים אחרים"))
#: Warning before something happens, and its absence.
NOTICE = any_of("הודעה", "התראה", "תיאום", "מראש")
NO_NOTICE = then(_WITHOUT, any_of("הודעה", "התראה"), 15)
NO_COORDINATION = then(_WITHOUT, any_of("תיאום", "הודעה"), 15)
#: All claims are given up.
WAIVES_ALL = then(CONCEPTS["WAIVER"], any_of("כל טענה", "כל זכות", "כל תביעה", "כל דרישה", "בלתי חוזר"), 40)
#: The security is cashed.
REALIZES = then(any_of("לממש", "יממש", "מימוש", "לחלט", "יחלט", "חילוט", "לפרוע"), CONCEPTS["SECURITY"], 50)
ENTERS = CONCEPTS["ENTRY"]
#: Costs of the building are put on the tenant.
OWNER_CHARGES = near(BUILDING_COSTS, _TENANT)
#: Repairs that the tenant made are not paid back.
NO_REFUND = then(any_of("לא יהיה זכאי", "לא תהיה זכאית", "אינו זכאי", "אינה זכאית", "לא יקבל"), any_of("החזר", "פיצוי", "שיפוי"), 20)
SELF_REPAIR = either(CONCEPTS["SELF_REPAIR"], any_of("תיקון שביצע", "תיקונים שביצע", "תיקון שביצעה"))
#: A clause puts a cost or a loss on the tenant.
SHIFTS_BURDEN = either(TENANT_PAYS, any_of("מוותר", "מוותרת", "לא יהיה זכאי", "לא תהיה זכאית"))

#: Leaving early: who may, who may not, and what it takes.
TENANT_MAY_END = then(any_of("שוכר", "שוכרת", "כל צד", "כל אחד מהצדדים"), _MAY, 15)
NO_TENANT_RIGHT = either(then(any_of("אין לשוכר", "אין לשוכרת", "לשוכר אין", "לא תהיה לשוכר", "לשוכר לא תהיה"), any_of("זכות", "אפשרות", "רשות"), 20), any_of("שוכר אינו רשאי", "שוכרת אינה רשאית", "שוכר לא יהיה רשאי"))
REPLACEMENT = any_of("שוכר חלופי", "שוכר מחליף", "דייר חלופי", "דייר מחליף")
NO_REPLACEMENT = then(any_of("אין", "ללא", "לא יוכל", "לא תוכל", "לא רשאי"), REPLACEMENT, 40)
REPLACEMENT_REQUIRED = then(any_of("בלבד", "בתנאי", "עד למציאת", "עד שימצא", "עד שתמצא"), REPLACEMENT, 40)
MAY_PROPOSE = then(_MAY, REPLACEMENT, 40)
PAYS_TO_END = RENT_TO_END
FIXED_MONTHS = rf"(?iu)דמי\s+{PREFIX}שכירות\s+(?:עבור|של|בגין)\s+(\d+|\p{{L}}+)\s+חודשים|(\d+|\p{{L}}+)\s+חודשי\s+{PREFIX}שכירות"
#: How much a reading of an exit term says. Fixed values.
SPECIFICITY = {"UNTIL_END": 6, "FIXED_AMOUNT": 5, "FIXED_MONTHS": 5, "UNTIL_REPLACEMENT": 4, "ALLOWED_WITH_NOTICE": 3, "NOT_ALLOWED": 2}
