"""Shared SQL for the checks."""


def names(x):
    return f"(CASE WHEN coalesce({x}, '') = '' THEN [] ELSE string_split({x}, ', ') END)"


# One row per bridge match; bridge matches have one preview and one end.
PM = f"""
ko AS (
  SELECT user_id_text u, job_id j, match m, event_idx,
    CASE WHEN actor = 'opponent' THEN 'player' ELSE 'opponent' END scored_by,
    sum(CASE WHEN actor = 'opponent' THEN 1 ELSE -1 END)
      OVER (PARTITION BY user_id_text, job_id, match ORDER BY event_idx) diff
  FROM ev WHERE event = 'pokemon_fainted'),
koagg AS (
  SELECT u, j, m, max(diff) > 0 was_ahead, arg_min(scored_by, event_idx) first_ko FROM ko GROUP BY ALL),
pm0 AS (
  SELECT user_id_text u, job_id j, match m,
    max(winner) FILTER (WHERE event = 'battle_end') winner,
    max(player_lead) pl, max(opponent_lead) ol, max(player_brought) pb, max(opponent_brought) ob,
    max(player_team) pt, max(opponent_team) ot, max(illegal_species_detected) illegal,
    max(detail) FILTER (WHERE event = 'battle_end') winner_detail,
    count(*) FILTER (WHERE event = 'pokemon_fainted' AND actor = 'player') p_faints,
    count(*) FILTER (WHERE event = 'pokemon_fainted' AND actor = 'opponent') o_faints,
    count(*) FILTER (WHERE event = 'terastallized' AND actor = 'player') tera_n,
    min(event_idx) first_idx
  FROM ev GROUP BY ALL),
pm AS (
  SELECT pm0.*, coalesce(was_ahead, false) was_ahead, first_ko, winner = 'player' won,
    list_sort({names('pl')}) p_lead, list_sort({names('ol')}) o_lead,
    {names('pb')} p_brought,
    CASE WHEN coalesce(ob, '') = '' THEN {names('ot')} ELSE {names('ob')} END o_brought,
    {names('pt')} p_team, {names('ot')} o_team,
    CASE WHEN coalesce(pb, '') = '' THEN 4 ELSE len(string_split(pb, ', ')) END brought_n,
    CASE WHEN winner = 'player' THEN greatest(0,
      (CASE WHEN coalesce(pb, '') = '' THEN 4 ELSE len(string_split(pb, ', ')) END) - p_faints) ELSE 0 END margin,
    (j, first_idx) seen
  FROM pm0 LEFT JOIN koagg USING (u, j, m))
"""
DECIDED = "SELECT * FROM pm WHERE winner IN ('player', 'opponent')"
