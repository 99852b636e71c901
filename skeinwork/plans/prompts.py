"""Prompt wording; slots are {{question}}, {{options}}, {{context}}."""

SYSTEM_EVIDENCE = (
    "Answer as a reference tool, only from the numbered passages below. Close each factual sentence with the label of its passage, "
    "such as the ones shown in brackets. If the passages do not answer the question, reply INSUFFICIENT_EVIDENCE and nothing else. Write short, plain prose."
)
PLAIN_SYSTEM = "You answer multiple-choice questions. Think step by step, then give the letter. Reply as JSON with the keys step_by_step_thinking and answer_choice."
PLAIN = "Question:\n{{question}}\n\nOptions:\n{{options}}\n\nReply as JSON:"
CONTEXT_SYSTEM = "You answer multiple-choice questions with the help of the documents given. Think step by step, then give the letter. Reply as JSON with the keys step_by_step_thinking and answer_choice."
CONTEXT = "Documents:\n{{context}}\n\nQuestion:\n{{question}}\n\nOptions:\n{{options}}\n\nReply as JSON:"
FOLLOW_UP_SYSTEM = "You break a question down into searches, read what they find, and answer when you know enough."
ASK = "Before you answer, write {{n}} search queries under the heading ## Queries, with a short analysis of what is still unknown."
ANSWER = "Answer now, under the heading ## Answer, from what was found."
AS_JSON = "Give the answer alone, as JSON with the key answer."
EXTRACT = 'List the queries of this passage unchanged as JSON {"output": ["..."]}:\n{{reply}}'

#: Sections style: one text with headings in place of separate messages, an example of the wanted form first.
_SECTIONS = (
    "### User:\nQuestion:\n(a question)\n\nOptions:\nA. (one)\nB. (another)\n\nReply as JSON.\n\n### Assistant:\n"
    '{"step_by_step_thinking": "(why B)", "answer_choice": "B"}\n\n### User:\nQuestion:\n{{question}}\n\nOptions:\n{{options}}\n\nReply as JSON.\n\n### Assistant:\n'
)
SIMPLE = "{{context}}\n\n{{question}}\n\n{{options}}\n\nAnswer with the letter alone:"

#: name -> (system message or none, user message)
FORMS = {
    "plain": (PLAIN_SYSTEM, PLAIN),
    "context": (CONTEXT_SYSTEM, CONTEXT),
    "sections_plain": (PLAIN_SYSTEM, _SECTIONS),
    "sections_context": (CONTEXT_SYSTEM, "Documents:\n{{context}}\n\n" + _SECTIONS),
    "simple": (None, SIMPLE),
}


def form_for(model: str, context: bool) -> str:
    """The form that suits a model by its name: models that continue one text get sections, small ones the simple form."""
    name = model.lower()
    if "meditron" in name:
        return "sections_context" if context else "sections_plain"
    if "pmc" in name:
        return "simple"
    return "context" if context else "plain"
