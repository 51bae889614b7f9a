"""Analytics over web-research corpora on Spark."""

from corpusloom.functions.documents import extract, extract_documents
from corpusloom.operators.corpus import evidence, greedy_dedup, similar_links
from corpusloom.operators.crawl import crawl_domain, crawl_domains, crawl_site, crawl_sites, map_site, map_sites
from corpusloom.operators.fetching import fetched
from corpusloom.operators.monitor import changes, due, due_cycle, lease, topic_runs
from corpusloom.operators.registry import registered, task_briefings, topic_briefings, topic_digests
from corpusloom.operators.research import discover, plan, report, research_topic, resume, search

__all__ = [
    "changes", "crawl_domain", "crawl_domains", "crawl_site", "crawl_sites", "discover", "due", "due_cycle", "evidence", "extract", "extract_documents", "fetched", "greedy_dedup", "lease", "map_site",
    "map_sites", "plan", "registered", "report", "research_topic", "resume", "search", "similar_links", "task_briefings", "topic_briefings", "topic_digests", "topic_runs"]
