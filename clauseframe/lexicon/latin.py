"""Concepts and number subjects for the driver's documents, as data. Patterns avoid look-around, so that SQL can run them."""

CONCEPTS = {
    "LICENSE": r"licen[sc]e|copyright",
    "CONTACT": r"[a-z0-9._%+-]+@[a-z0-9.-]+|contact|phone",
    "ACCESS": r"password|passwd|token|secret|api_?key",
    "CODE": r"def |return |import |function",
    "CONJUNCTION": r" and | und | et | con ",
}
SUBJECTS = {"contact": r"contact|phone|call", "network": r"host|server|address|from", "version": r"version|licen[sc]e"}
