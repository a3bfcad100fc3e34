SELECT textLanguage, count(*) AS posts
FROM s7_posts
WHERE playCount > :plays
GROUP BY textLanguage;
