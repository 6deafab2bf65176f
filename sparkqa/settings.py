"""Fixed values that results depend on.

FIXED VALUES: these texts, names and limits must stay exactly as written for
answers, prompts and error rows to come out right (blanks at line ends of the prompts don't
matter and are left out). They are kept together here in their natural order.
"""

# --- retrieval answerer -------------------------------------------------------
RAG_PROMPT_TEMPLATE = (
    "You are an assistant that answers questions. Use only the information in context "
    "to answer the question at the end. Some pieces of context may be irrelevant, in which "
    "case you should not use them to form the answer. Only answer question from the context, "
    "do not add anymore information. If the question is not relevant to COVID Trials, only "
    "respond with 'Irrelevant Question'. \n\nContext: {supporting_documents}, \n\nQuestion:{query}"
)
IRRELEVANT = "Irrelevant Question"
REFERENCE_LINKS = "\n\nReference Links:\n"
RETRIEVE_COLUMNS = ["title", "interventions", "url"]
RETRIEVE_K = 3
SMOKE_NUM_RESULTS = 1
RAG_MAX_TOKENS = 1500
TEMPERATURE = 0.01
SMOKE_QUERY = "What are pregnancy related complications in COVID-19 patients"
NO_RECORDS = "No records"

# --- requests -----------------------------------------------------------------
NO_USER_MESSAGE = "No user message found in input messages."
DEFAULT_NUM_ATTEMPTS = 0
DEFAULT_MAX_ATTEMPTS = 3
UI_ERROR_REPLY = "An error occured"

# --- structured answers -------------------------------------------------------
QUESTION_PREFIX = "Explain your answer in few words. "
ANSWER_PREFIX = "Answer is : "

# --- tools --------------------------------------------------------------------
NO_MATH = "Cannot formulate a math expression "

# --- multi-agent routing ------------------------------------------------------
AGENT_CATALOG = [
    ("covid_rag_agent",
     "Can be used for questions related to names and descriptions of publications about covid trials."),
    ("covid_genie_agent",
     "Can be used for questions specific to statistics and information about COVID clinical trials."),
    ("helper_agent",
     "Can be used for questions related to finding general information, current date, for performing "
     "web search and executing mathematical calculations"),
]
RAG_AGENT, STATS_AGENT, HELPER_AGENT = (name for name, _ in AGENT_CATALOG)
DONE = "DONE"
USER_RESPONSE = "USER_RESPONSE"
MAX_TRIES = "MAX_TRIES"
NEXT_ACTION = "NEXT_ACTION"
AGENT_ERROR = "AGENT_ERROR"
NO_HISTORY = " - None"
MAX_TRIES_TEXT = "- error_response: Number of attempts to find answer exceeded max attempts of "
NO_FINAL_RESPONSE = "No response provided by the multi agent."
UNKNOWN_AGENT = "Unknown agent: "

PLAN_PROMPT = """
  Given the question and information given below, find the next agent to invoke from the list of agents.
  If all information is available and no more agents need to be invoked, you MUST respond with just the word DONE.
  You can break the question into smaller sub-questions and identify the next step.
  If the question is not relevant to COVID Trials, only respond with 'Irrelevant Question' and respond DONE
  You MUST use only the below information, nothing else. Don't assume anything.
  * Question: {question}

  * Information
  {past_agent_responses_from_state}

  You can only pick one of the following agents:
  * List of Agents:
  {agent_names_for_prompt}

  Only respond with the agent_name and question in the given output format.
  * Output format:
  agent_name:question

  """

FINAL_MESSAGE_PROMPT = """
  Provide a final answer to the user explaining the answer in a profesional way.
  You must use only the below information to answer the question, nothing else.
  If there is an error_response, send just the error response back to the user.
  If there are any references to documents, list all the document references at the end with URL link.
  You MUST use only the below information to answer the question, nothing else:
  ##Information
  {past_agent_responses_from_state}
  ##Question: {question}
  """

# --- trials data --------------------------------------------------------------
STATUS_BY_CODE = [("F", "Completed"), ("O", "Recruiting"), ("P", "Not yet recruiting")]
TRIAL_URL_PREFIX = "https://ClinicalTrials.gov/show/"
MONTH_DAY_YEAR = "MMMM d yyyy"
MONTH_YEAR = "MMMM yyyy"
LONG_DATE = "MMMM dd, yyyy"
